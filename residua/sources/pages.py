"""Pages of an approved search, one at a time, by an opaque cursor that is bound to the approved query."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable
from pathlib import Path
from urllib.parse import parse_qs, urlencode, urlsplit

#: Exit codes of a broken contract and of a passing failure, the codes of the latter in answers, and the page size.
CONTRACT, TEMPORARY = 3, 75
RETRIED = frozenset({408, 429, 500, 502, 503, 504})
MOST_RECORDS, ATTEMPTS = 200, 3
PATH, PARAMETERS = "/uniprotkb/search", frozenset({"query", "format", "size", "cursor"})


class BrokenContract(RuntimeError):
    """The scope or the shape of an answer is not what was approved; trying again changes nothing."""


class TemporaryFailure(RuntimeError):
    """The server did not answer; the cursor stays where it is."""


class HttpStatus(RuntimeError):
    def __init__(self, code: int):
        super().__init__(f"status {code}")
        self.code = code


def first_address(host: str, query: str, size: int) -> str:
    return f"https://{host}{PATH}?" + urlencode({"query": query, "format": "fasta", "size": size})


def check_address(url: str, host: str, query: str, size: int) -> None:
    """Raise unless the address asks the approved host, over TLS, for no more than the approved query."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError as error:
        raise BrokenContract(f"not an address: {error}") from error
    if (parts.scheme, parts.hostname, parts.path) != ("https", host, PATH) or port not in (None, 443) or parts.fragment or parts.username is not None or parts.password is not None:
        raise BrokenContract("the address leaves the approved endpoint")
    asked = parse_qs(parts.query, keep_blank_values=True)
    if asked.keys() - PARAMETERS or asked.get("query") != [query] or asked.get("format") != ["fasta"] or len(asked.get("cursor", [])) > 1:
        raise BrokenContract("the address asks for something else than the approved query")
    sizes = asked.get("size", [])
    if len(sizes) != 1 or not sizes[0].isdecimal() or not 1 <= int(sizes[0]) <= size:
        raise BrokenContract("the page size is not approved")


def next_address(link: str | None) -> str | None:
    """The target of the ``rel="next"`` part of a Link header."""
    for part in (link or "").split(","):
        target, *attributes = part.split(";")
        if any('rel="next"' in a for a in attributes):
            return target.strip().strip("<>")
    return None


def fixture_transport(folder: str) -> Callable[[str], tuple[bytes, str | None]]:
    """Pages ``page-0.fasta``, ``page-1.fasta``, ... of a folder, with the next address in ``page-0.next``, ...; the place is kept in ``.idx``."""
    at = Path(folder)

    def get(_url: str) -> tuple[bytes, str | None]:
        place = at / ".idx"
        i = json.loads(place.read_text())["i"] if place.exists() else 0
        follow = at / f"page-{i}.next"
        body = (at / f"page-{i}.fasta").read_bytes()
        place.write_text(json.dumps({"i": i + 1}))
        return body, (follow.read_text().strip() or None) if follow.exists() else None

    return get


def fetch(url: str, host: str, transport: Callable[[str], tuple[bytes, str | None]], wait: Callable[[float], None] = time.sleep) -> tuple[bytes, str | None]:
    """Body and next address of a page; up to three attempts, each after twice the pause of the one before."""
    if urlsplit(url).hostname != host:
        raise BrokenContract("the host is not approved")
    for attempt in range(ATTEMPTS):
        try:
            body, follow = transport(url)
        except HttpStatus as error:
            if error.code not in RETRIED:
                raise BrokenContract(f"the request was refused with {error.code}") from error
            failure: Exception = error
        except (ConnectionError, TimeoutError) as error:
            failure = error
        else:
            if follow and urlsplit(follow).hostname != host:
                raise BrokenContract("the next page is on another host")
            return body, follow
        if attempt + 1 < ATTEMPTS:
            wait(2.0**attempt)
    raise TemporaryFailure(str(failure)) from failure


def check_body(body: bytes, size: int) -> int:
    """Records of a page: it must be FASTA and hold between one and ``size`` of them."""
    if not body.lstrip().startswith(b">"):
        raise BrokenContract("the answer is no FASTA")
    records = sum(line.startswith(b">") for line in body.splitlines())
    if not 0 < records <= size:
        raise BrokenContract(f"{records} records in a page of at most {size}")
    return records


def write_json(path: str | Path, value: dict) -> None:
    """Replace a JSON file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, sort_keys=True)
    os.replace(part, path)


def refill(rotation_file: str, queries_file: str, inbox: str, host: str, transport: Callable, *, page_size: int = MOST_RECORDS, wait: Callable[[float], None] = time.sleep) -> Path:
    """Fetch one page into the inbox and move the cursor on; after the last page of a query the next query's turn comes.

    The cursor counts only while both the digest of ``queries_file`` and the query's id are those it was
    written with; else the rotation starts again. A failure leaves the rotation as it was.
    """
    source = Path(queries_file).read_bytes()
    digest = "sha256:" + hashlib.sha256(source).hexdigest()
    listed = json.loads(source)
    queries = listed.get("queries") if isinstance(listed, dict) and listed.get("schemaVersion") == 1 else None
    if not queries or not all(isinstance(q.get(k), str) and q[k] for q in queries for k in ("id", "uniprotQuery")):
        raise BrokenContract("queries with ids and texts are needed")
    held = json.loads(Path(rotation_file).read_text()) if Path(rotation_file).exists() else {}
    at = int(held.get("queryIndex", 0)) % len(queries)
    bound = (held.get("approvedQueryDigest"), held.get("queryId")) == (digest, queries[at]["id"])
    at, cursor = (at, held.get("nextCursor")) if bound else (0, None)
    query = queries[at]
    size = min(int(query.get("pageSize", page_size)), MOST_RECORDS)
    if size <= 0:
        raise BrokenContract("the page size must be positive")
    url = cursor or first_address(host, query["uniprotQuery"], size)
    check_address(url, host, query["uniprotQuery"], size)
    body, follow = fetch(url, host, transport, wait)
    if follow:
        check_address(follow, host, query["uniprotQuery"], size)
    check_body(body, size)
    Path(inbox).mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f"page_{query['id']}_{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_", suffix=".part", dir=inbox)
    with os.fdopen(handle, "wb") as out:
        out.write(body)
    done = Path(name).with_suffix(".fasta")  # only whole files carry the name that the worker looks for
    os.replace(name, done)
    turn = at if follow else (at + 1) % len(queries)
    moved = {"queryIndex": turn, "queryId": queries[turn]["id"], "approvedQueryDigest": digest, "nextCursor": follow, "schemaVersion": 1}
    write_json(rotation_file, held | moved)
    return done
