"""WARC 1.1 records: writing, reading, URL keys, and storage that all executors reach."""

from __future__ import annotations

import zlib
from urllib.parse import quote, urlsplit

CRLF = b"\r\n"


def storage(uri: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """The host's labels from the last, then path and sorted query: captures of a site stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
    except ValueError:
        return url.lower()
    host = (parts.netloc.rpartition("@")[2].partition(":")[0]).removeprefix("www.")
    query = "&".join(sorted(q for q in parts.query.split("&") if q))
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + query if query else "")


def record(kind: str, record_id: str, url: str | None, date: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member. A revisit has the HTTP header of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    header = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        header += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    header += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("ascii") for k, v in header if v) + CRLF
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head + block + CRLF + CRLF) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, body) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF + CRLF)
    version, *lines = head.decode("ascii").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version!r}")
    warc = dict(x.split(": ", 1) for x in lines)
    http, _, body = rest[: int(warc["Content-Length"])].partition(CRLF + CRLF)
    return warc, dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:]), body


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, so a step replays one leaf's path, log2 k matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.next = [0] * self.k
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _key(self, leaf: int):
        return self.runs[leaf][self.next[leaf]] if self.next[leaf] < len(self.runs[leaf]) else None

    def _wins(self, a: int, b: int) -> bool:
        """Leaf a before leaf b; a leaf that has run out is after all, an unplayed place (-1) waits for its match."""
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._wins(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (key := self._key(leaf := self.losers[0])) is not None:
            yield leaf, key
            self.next[leaf] += 1
            self._play(leaf)
