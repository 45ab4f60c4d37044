"""Secrets in texts: plain patterns, and structures confirmed by decoding.

A pattern alone reports much that is no secret and misses keys that stand
without a name. So besides the plain patterns, base64 and hex runs are decoded
and reported only if bytes parse as a private key, with all nested lengths in
place, or as a signed token with a readable header. A run may be wrapped over
lines (the first of 16 characters or more), its line ends may be spelled as
escapes (``\\n``), and a key may start and end anywhere in it, so a path or a
name may be glued to it. A run that decodes to a text with an armoured key or a
signed token is reported from the character on that spells its begin to the end
of the line that spells its end. A run without padding takes in a next line that
begins with characters of its alphabet, as that may be its rest.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem_key", "der_key", "ssh_key", "signed_token")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
_ESCAPED = re.compile(r"\\+(?:([rnt])|u([0-9A-Fa-f]{4})|(?=/))")
_LINE_END = re.compile(r"[ \t]*(?:\r\n?|\n)[ \t]*")
#: Line ends, plain or escaped, and the backslash of an escaped slash.
_BREAK = r"(?:(?:[ \t]*(?:[\r\n]|\\+[rn]))+[ \t]*|\\+(?=/))"
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
_LOWER_HEX, _UPPER_HEX = (re.compile(rf"[0-9{x}]{{16,}}(?:{_BREAK}[0-9{x}]+)*") for x in ("a-f", "A-F"))
_BREAKS = re.compile(_BREAK)
#: How keys begin, and "-----BEGIN" and "eyJ" at each place within three bytes, with the characters before.
_BASE64_MARKS = re.compile(
    r"(?=(?:(?P<der>M[A-I])|(?P<ssh>b3BlbnNzaC1rZXktdjE)|(?P<at0>LS0tLS1CRUdJT|ZXlK)"
    r"|(?P<at2>0tLS0tQkVHSU|V5S)|(?P<at3>tLS0tLUJFR0lO|leU[opqr])))"
)
_HEX_MARKS = re.compile(
    r"(?=(?:(?P<der>30)|(?P<ssh>6f70656e7373682d6b65792d763100)|(?P<at0>2d2d2d2d2d424547494e|65794a)))", re.I
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_NAMES = ("password", "passwd", "secret", "token", "api")
_SSH = b"openssh-key-v1\0"

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _base64_bytes(text: str) -> bytes | None:
    text = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill ``data`` exactly, else nothing; no key has over 16 side by side."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(out) == 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """A private key as one SEQUENCE: RSA, DSA, EC, PKCS #8, plain or encrypted."""
    integer, octets, oid, sequence = 0x02, 0x04, 0x06, 0x30
    if not data or len(data) < 32 or data[0] != sequence:
        return False
    top = _elements(data)
    inner = _elements(top[0][1]) if top and len(top) == 1 else None
    if not inner:
        return False
    tags = [tag for tag, _ in inner]

    def algorithm(content: bytes) -> bool:
        own = _elements(content)
        return bool(own) and own[0][0] == oid

    if tags == [sequence, octets]:  # encrypted
        return algorithm(inner[0][1])
    if tags[0] != integer or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False
    if tags[1:3] == [sequence, octets]:
        return algorithm(inner[1][1])
    if tags[1:2] == [octets]:
        return 20 <= len(inner[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return set(tags) == {integer} and len(tags) in (6, 9)


def _der_key_end(data: bytes, at: int) -> int:
    """Where the private key that begins at ``at`` ends, by its own length; 0 if there is none."""
    head = data[at : at + 9]
    if len(head) < 9 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return 0
    inner = 2 + n
    end = at + inner + (int.from_bytes(head[2:inner], "big") if n else head[1])
    # Its first element is a version or a SEQUENCE; a longer look is only worth it then.
    if end > len(data) or not (head[inner] == 0x30 or head[inner : inner + 2] == b"\x02\x01"):
        return 0
    return end if is_der_key(data[at:end]) else 0


def _ssh_key_end(data: bytes, start: int = 0) -> int:
    """Where the OpenSSH container that begins at ``start`` ends; 0 if there is none."""
    if data[start : start + len(_SSH)] != _SSH:
        return 0
    at = start + len(_SSH)

    def string() -> int | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return size

    if any(string() is None for _ in range(3)):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(string() for _ in range(keys)) and string() else 0


def is_ssh_key(data: bytes | None) -> bool:
    """The container of OpenSSH keys: magic, then strings with their lengths."""
    return bool(data and _ssh_key_end(data))


def is_signed_token(header: str, payload: str) -> bool:
    """The header is a JSON object that names its algorithm, the payload is one too."""
    try:
        head, body = (json.loads(_base64_bytes(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns, leftmost and without overlap per kind."""
    lower, out = text.lower(), []
    if any(name in lower for name in _NAMES):
        out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _has_long_word(text):
        out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return out


def _has_long_word(text: str, size: int = 24) -> bool:
    """Whether a run of so many characters without white space occurs; all encodings looked for have such runs."""
    return max(map(len, text.split()), default=0) >= size


def _unescaped(text: str) -> str:
    """Line ends and other characters that a JSON text spells as escapes."""
    if "\\" not in text:
        return text
    plain = {"r": "\r", "n": "\n", "t": "\t"}
    return _ESCAPED.sub(lambda m: plain[m[1]] if m[1] else chr(int(m[2], 16)) if m[2] else "", text)


def _base64_from(run: str) -> bytes:
    """Of a run of base64 characters only, as far as whole bytes go."""
    size = len(run) if len(run) % 4 != 1 else len(run) - 1
    return _base64_bytes(run[:size]) or b""


def _hex_from(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def _spare_bits(last: str, size: int) -> int:
    """The bits of the last character that hold no more of ``size`` bytes."""
    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/".find({"-": "+", "_": "/"}.get(last, last))
    return value & (0, 15, 3)[size % 3]


def _run_spans(text: str, runs: re.Pattern, marks: re.Pattern, base64_run: bool, pems: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """What begins at a mark within a run."""
    out = []
    chars, size = (4, 3) if base64_run else (2, 1)
    decode = _base64_from if base64_run else _hex_from
    for m in runs.finditer(text):
        run, places = m[0], None
        breaks = [b.span() for b in _BREAKS.finditer(run)]
        if breaks:
            # The body of an armoured key is reported with its armour.
            if any(a <= m.start() < b for a, b in pems):
                continue
            whole, places, at = run, [], 0
            for a, b in [*breaks, (len(run), len(run))]:
                places.extend(range(at, a))
                at = b
            run = "".join(whole[i] for i in places)
        if len(run) < 32:
            continue

        def source(at: int) -> int:
            return m.start() + (places[at] if places is not None else at)

        decoded: dict[int, bytes] = {}  # from each first place within a group of characters on
        read, after = set(), 0
        for mark in marks.finditer(run):
            kind, start = mark.lastgroup, mark.start()
            inside = kind.startswith("at")
            start -= int(kind[2:]) if inside else 0
            if start < 0 or start < after:
                continue
            phase = start % chars
            if phase not in decoded:
                decoded[phase] = decode(run[phase:])
            data, at = decoded[phase], (start - phase) // chars * size
            if inside:
                if phase in read:
                    continue
                read.add(phase)
                found = confirmed_spans(data[at:].decode("latin-1"))
                found = [(k, b) for k, _, b in found if k in ("pem_key", "signed_token")]
                kinds, n = {k for k, _ in found}, max((b for _, b in found), default=0)
                # To the end of the line.
                end = min(len(run), start + (-(-n * 4 // 3) if base64_run else 2 * n))
                while kinds and end < len(run) and (places is None or places[end] == places[end - 1] + 1):
                    end += 1
            else:
                end = _der_key_end(data, at) if kind == "der" else _ssh_key_end(data, at)
                kinds, n = {f"{kind}_key"} if end else set(), end - at
                end = start + (-(-n * 4 // 3) if base64_run else 2 * n)
                if kinds and base64_run and _spare_bits(run[end - 1], n):
                    continue
            if kinds:
                last = source(end - 1) + 1
                if base64_run and (end == len(run) or text[last : last + 1] == "="):
                    last += min(2, len(text[last : last + 2]) - len(text[last : last + 2].lstrip("=")))
                out += [(k, source(start), last) for k in sorted(kinds)]
                after = end
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decoding and parsing confirms."""
    out = []
    if not _has_long_word(text, 16):
        return out
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            body = _LINE_END.sub("\n", _unescaped(m[2]))
            sealed = "ENCRYPTED" in body.split("\n\n")[0] and ":" in body
            data = _base64_bytes("".join(body.split("\n\n")[-1].split()))
            if is_der_key(data) or is_ssh_key(data) or sealed and data:
                out.append(("pem_key", *m.span()))
    pems = [(start, end) for _, start, end in out]
    out += _run_spans(text, _BASE64, _BASE64_MARKS, True, pems)
    for runs in (_LOWER_HEX, _UPPER_HEX):
        out += _run_spans(text, runs, _HEX_MARKS, False, pems)
    if "eyJ" in text:
        out += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return list(dict.fromkeys(out))


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base and confirmed spans by start, then kind as listed in ``KINDS``."""
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], order[s[0]], s[2]))


def secret_spans(text: Column) -> Column:
    """Spans of a text column, as an array of (kind, start, end).

    Positions count code points, ends are exclusive. A null or empty text has
    no spans. Spans of different kinds may overlap. Rows are independent, so
    repeats and other columns do not matter.
    """

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t or "")] for t in texts.to_pylist()
        ]
        return pa.array(rows, SPANS)

    return spans(text)


def redacted(text: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal stretch of overlapping spans replaced by ``mark``; null stays null."""

    def cover(t: str | None) -> str | None:
        out, at = [], 0
        for _, start, end in all_spans(t or ""):
            if start >= at:
                out += [t[at:start], mark]
            at = max(at, end)
        return "".join(out) + t[at:] if out else t

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cover(t) for t in texts.to_pylist()], pa.string())

    return run(text)
