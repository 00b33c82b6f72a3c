"""Landing step: fetch feed files with conditional requests, then let Spark read them.

Runs on the driver, one file a call; everything after it is Spark's work.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

ATTEMPTS, PAUSE_S, POST_ATTEMPTS, POST_BYTES = 5, 2.0, 3, 50 << 20


@dataclass(frozen=True)
class Fetched:
    path: str
    changed: bool
    etag: str | None = None
    last_modified: str | None = None


def fetch(url: str, path: str, etag: str | None = None, last_modified: str | None = None, pause: float = PAUSE_S) -> Fetched:
    """Fetch ``url`` to ``path`` unless the server says it is as known.

    The ETag asks first, else the modification time; without a local copy neither. Broken
    transfers resume where they stopped if the server grants a range, else start again. The file
    appears under its name only when it is whole.
    """
    part, last = f"{path}.part", None
    if os.path.exists(part):
        os.remove(part)
    for n in range(ATTEMPTS):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        head = {"Range": f"bytes={have}-"} if have else {}
        if not have and os.path.exists(path):
            head |= {"If-None-Match": etag} if etag else {"If-Modified-Since": last_modified} if last_modified else {}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=60) as r:
                expected = int(r.headers.get("Content-Length") or 0)
                before = have if r.status == 206 else 0
                with open(part, "ab" if before else "wb") as out:
                    while chunk := r.read(1 << 20):
                        out.write(chunk)
                if expected and os.path.getsize(part) < before + expected:
                    raise ConnectionError("the transfer ended early")
                os.replace(part, path)
                return Fetched(path, True, r.headers.get("ETag"), r.headers.get("Last-Modified"))
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return Fetched(path, False, etag, last_modified)
            last = e
        except (OSError, ConnectionError) as e:
            last = e
        time.sleep(pause if n + 1 < ATTEMPTS else 0)
    raise ConnectionError(f"{url} could not be fetched") from last


def fetch_post(url: str, path: str, form: bytes, pause: float = PAUSE_S) -> Fetched:
    """POST ``form``; the answer has to be JSON of at most 50 MB."""
    last: Exception | None = None
    for n in range(POST_ATTEMPTS):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=form), timeout=60) as r:
                body = r.read(POST_BYTES + 1)
            if len(body) > POST_BYTES:
                raise ValueError("the answer is too large")
            json.loads(body)
            with open(f"{path}.part", "wb") as out:
                out.write(body)
            os.replace(f"{path}.part", path)
            return Fetched(path, True)
        except (OSError, ValueError) as e:
            last = e
            time.sleep(pause if n + 1 < POST_ATTEMPTS else 0)
    raise ConnectionError(f"{url} could not be fetched") from last


def newest_dated(index: str, pattern: str) -> str | None:
    """The link of an index page whose eight-digit date, as ``pattern``'s group, is the latest."""
    found = [(m.group(1), m.group(0)) for m in re.finditer(pattern, index)]
    return max(found)[1] if found else None
