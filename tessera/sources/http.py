"""Files read by ranges over http(s)."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from functools import cached_property

TRIES, WAIT, TIMEOUT = 5, 0.2, 60.0


class HttpFile:
    """A remote file: its size from HEAD (or from the answer to a one-byte range), parts of it from Range requests.

    Requests that time out, break off or meet an error of the server's are made again, up to TRIES times, waiting twice as long each time;
    what the server refuses (4xx) is an error at once. A server that answers a range with the whole file is an error too, unless
    the range begins the file: nothing else is downloaded than what is asked for.
    """

    def __init__(self, url: str, tries: int = TRIES, wait: float = WAIT) -> None:
        self.url, self.tries, self.wait = url, tries, wait

    def __enter__(self) -> HttpFile:
        return self

    def __exit__(self, *_: object) -> None:
        pass

    def _asked(self, method: str, headers: dict[str, str], most: int) -> tuple[int, http.client.HTTPMessage, bytes]:
        """Status, headers and up to most bytes."""
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, method=method, headers=headers), timeout=TIMEOUT) as answer:
                    body = answer.read(most) if most else b""
                    if len(body) < most and answer.headers.get("Content-Length") not in (None, str(len(body))):
                        raise http.client.IncompleteRead(body)
                    return answer.status, answer.headers, body
            except urllib.error.HTTPError as error:
                if error.code < 500 or attempt == self.tries - 1:
                    raise OSError(f"{self.url}: {error.code} {error.reason}") from error
            except (OSError, http.client.HTTPException) as error:
                if attempt == self.tries - 1:
                    raise OSError(f"{self.url}: {error}") from error
            time.sleep(self.wait * 2**attempt)
        raise OSError(f"{self.url}: no tries")

    @cached_property
    def _size(self) -> int:
        try:
            length = self._asked("HEAD", {}, 0)[1].get("Content-Length")
        except OSError:  # HEAD may be refused where GET is not
            length = None
        if length is None:
            length = self._asked("GET", {"Range": "bytes=0-0"}, 1)[1].get("Content-Range", "").rpartition("/")[2]
        if not length.isdigit():
            raise OSError(f"{self.url}: the server doesn't say how large it is")
        return int(length)

    def size(self) -> int:
        return self._size

    def read_at(self, size: int, at: int) -> bytes:
        """Up to size bytes from a place on; fewer at the end."""
        size = min(size, self._size - at)
        if size <= 0:
            return b""
        status, _, body = self._asked("GET", {"Range": f"bytes={at}-{at + size - 1}"}, size)
        if status != 206 and at:
            raise OSError(f"{self.url}: the server doesn't serve ranges")
        if len(body) < size:
            raise OSError(f"{self.url}: {len(body)} bytes instead of {size}")
        return body
