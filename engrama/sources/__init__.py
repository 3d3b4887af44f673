"""Reading and writing stores and their sidecar files."""
