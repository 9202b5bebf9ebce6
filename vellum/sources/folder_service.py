"""A service of records that are files: what a plan would do, tried without a network.

It answers as the remote one does: collections with pages, lookups by external id, new
records by POST, changes by PATCH, DELETE; 404 for what is not there and 422 for a body
with a field named `refuse`.  A POST always makes a new record, so doubles show.

Records lie on 4,096 shelves by the hash of their external id.  A page of a collection has
to list all of it; a page of one shelf (`shelf=0af`) lists that shelf alone.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import uuid
from functools import cached_property

from pyarrow import fs

from vellum.sources.shared import filesystem, read_bytes, write_bytes


#: Hex digits of a shelf's name.
SHELF = 3
SHELVES = [f"{i:0{SHELF}x}" for i in range(16**SHELF)]


def place(record: str) -> str:
    """A record's file in its collection, from its id."""
    return f"{record[:SHELF]}/{record.replace('-', '/', 1)}.json"


class FolderService:
    """An opener for rest.Client over a folder that all tasks share."""

    def __init__(self, root: str):
        self.root = root

    @cached_property
    def at(self) -> tuple[fs.FileSystem, str]:
        return filesystem(self.root)

    def _files(self, folder: str) -> list[str]:
        system, base = self.at
        found = system.get_file_info(fs.FileSelector(f"{base}/{folder}", recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File)

    def __call__(self, url: str, headers: dict[str, str], method: str = "GET", data: bytes | None = None) -> tuple[int, dict[str, str], bytes]:
        system, base = self.at
        parts = urllib.parse.urlsplit(url)
        asked = dict(urllib.parse.parse_qsl(parts.query))
        name = parts.path.strip("/")
        where = lambda ext: hashlib.sha256(str(ext).encode()).hexdigest()[:24]
        if method == "POST":
            body = json.loads(data or b"{}")
            if "refuse" in body:
                return 422, {}, b'{"error": "refused"}'
            record = {**body, "id": f"{where(body.get('external_id'))}-{uuid.uuid4().hex}"}
            write_bytes(system, f"{base}/{name}/{place(record['id'])}", json.dumps(record).encode())
            return 201, {}, json.dumps(record).encode()
        collection, _, key = name.rpartition("/")
        path = f"{base}/{collection}/{place(key)}"
        if method in ("PATCH", "DELETE"):
            now = read_bytes(system, path)
            if now is None:
                return 404, {}, b"{}"
            if method == "DELETE":
                system.delete_file(path)
                return 204, {}, b""
            body = json.loads(data or b"{}")
            if "refuse" in body:
                return 422, {}, b'{"error": "refused"}'
            write_bytes(system, path, json.dumps({**json.loads(now), **body}).encode())
            return 200, {}, b"{}"
        if "external_id" in asked:
            h = where(asked["external_id"])
            name = f"{name}/{h[:SHELF]}/{h}"
        elif "shelf" in asked:
            name = f"{name}/{asked['shelf']}"
        files = self._files(name)
        size, page = int(asked.get("limit", 100)), int(asked.get("page", 1))
        rows = [json.loads(read_bytes(system, f)) for f in files[(page - 1) * size : page * size]]
        return 200, {"Total-Pages": str(max(1, -(-len(files) // size)))}, json.dumps(rows).encode()
