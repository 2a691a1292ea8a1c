"""External providers, always called from the driver and never by executors: a bounded POST, and judges in batches."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from ipaddress import ip_address
from urllib.parse import urlsplit

MOST_BYTES = 1 << 20
#: Status -> stable code.
CODES = {400: "E_PROVIDER_REQUEST", 401: "E_PROVIDER_AUTH", 403: "E_PROVIDER_AUTH", 404: "E_PROVIDER_NOT_FOUND", 409: "E_PROVIDER_STALE", 413: "E_PROVIDER_TOO_LARGE", 429: "E_PROVIDER_BUSY"}


class ProviderError(RuntimeError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def is_loopback(host: str) -> bool:
    try:
        return ip_address(host).is_loopback
    except ValueError:
        return host == "localhost"


def post(url: str, body: object, timeout: float = 30.0, headers: dict[str, str] | None = None) -> object:
    """The JSON answer to a JSON body: HTTPS, or HTTP to this machine; no redirects; at most MOST_BYTES either way."""
    parts = urlsplit(url)
    if parts.scheme != "https" and not (parts.scheme == "http" and is_loopback(parts.hostname or "")):
        raise ProviderError("E_PROVIDER_URL", "only https, or http to a loopback address")
    data = json.dumps(body).encode()
    if len(data) > MOST_BYTES:
        raise ProviderError("E_PROVIDER_TOO_LARGE", "the request")
    request = urllib.request.Request(url, data, {"content-type": "application/json", **(headers or {})}, method="POST")
    try:
        with urllib.request.build_opener(_NoRedirect, urllib.request.ProxyHandler({})).open(request, timeout=timeout) as answer:
            raw = answer.read(MOST_BYTES + 1)
    except urllib.error.HTTPError as e:
        raise ProviderError("E_PROVIDER_REDIRECT" if 300 <= e.code < 400 else CODES.get(e.code, "E_PROVIDER_FAILED"), str(e.code)) from None
    except OSError as e:
        raise ProviderError("E_PROVIDER_UNREACHABLE", str(e)) from None
    if len(raw) > MOST_BYTES:
        raise ProviderError("E_PROVIDER_TOO_LARGE", "the answer")
    try:
        return json.loads(raw)
    except ValueError:
        raise ProviderError("E_PROVIDER_ANSWER", "not JSON") from None


def judged_in_batches(candidates: list[dict], judge: Callable[[list[dict]], list[dict]], most: int = 8, most_bytes: int = 64 << 10) -> list[dict | None]:
    """A judgment for each candidate (a page of them), None where the judge fails. Batches have `most` candidates and bytes at most;
    one that the judge finds too large is halved, down to single candidates."""
    out: list[dict | None] = [None] * len(candidates)

    def ask(at: list[int]) -> None:
        try:
            got = judge([candidates[i] for i in at])
        except ProviderError as e:
            if e.code == "E_PROVIDER_TOO_LARGE" and len(at) > 1:
                ask(at[: len(at) // 2])
                ask(at[len(at) // 2 :])
            return
        if len(got) == len(at):
            for i, g in zip(at, got, strict=True):
                out[i] = g

    batch: list[int] = []
    size = 0
    for i, c in enumerate(candidates):
        n = len(json.dumps(c).encode())
        if batch and (len(batch) == most or size + n > most_bytes):
            ask(batch)
            batch, size = [], 0
        batch.append(i)
        size += n
    if batch:
        ask(batch)
    return out


def supported(question: str, claim: str, excerpts: list[str], assess: Callable[[str, str, list[str]], str] | None, valid: bool, most_chars: int = 4_000) -> str:
    """What an assessor says of a claim on current excerpts: supported, contradicted, insufficient; unknown if the sources aren't
    current or there is no assessor."""
    if any(len(x) > most_chars for x in excerpts):
        raise ProviderError("E_SUPPORT_TOO_LARGE", f"an excerpt has more than {most_chars} characters")
    if not valid or assess is None:
        return "unknown"
    said = assess(question, claim, excerpts)
    return said if said in ("supported", "contradicted", "insufficient") else "unknown"
