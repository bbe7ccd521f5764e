"""Text and paths shared by these tests."""

SMALL = "/root/testdata/sf0.001"
WORDS = "case evidence camera lens report note signed audit chain custody frame pixel sensor noise image hash label review finding engine".split()


def passage(n, start=0, step=1):
    """n words of invented prose that repeat no window of eight."""
    return " ".join(f"{WORDS[(start + i * step) % len(WORDS)]}{(start + i * i * step) % 97}" for i in range(n))
