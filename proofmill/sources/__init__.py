from .scans import load, load_all, read_manifest, read_raster, scan_corpus, label_from_path  # noqa: F401
