"""Files that tasks open themselves: local, mounted, hdfs:// and s3://, by pyarrow's file systems."""

from __future__ import annotations


def opened(uri: str):
    """A seekable file."""
    files, path = _split(uri)
    return files.open_input_file(path)


def put(uri: str, raw: bytes) -> None:
    """A new file; its folders are made."""
    files, path = _split(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(raw)


def listed(uri: str, ending: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the file, or of the files below the folder, whose names end so; hidden ones are left out."""
    from pyarrow import fs

    files, path = _split(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((head + x.path, x.size) for x in found if x.is_file and x.base_name.endswith(ending) and x.base_name[0] not in "._")


def _split(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)
