"""Files of any store that Arrow opens: local ones, and those named by a URI."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def size(system: fs.FileSystem, path: str) -> int:
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def span(system: fs.FileSystem, path: str, start: int = 0, end: int | None = None) -> bytes:
    """The bytes from start to end, as far as there are any."""
    with system.open_input_file(path) as f:
        end = f.size() if end is None else min(end, f.size())
        return f.read_at(end - start, start) if end > start else b""


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name first, so that a reader sees all of it or none."""
    with system.open_output_stream(path + ".new") as f:
        f.write(data)
    system.move(path + ".new", path)


def listed(system: fs.FileSystem, folder: str) -> list[str]:
    """The names in a folder, in order."""
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(folder)))
