"""Secret scans: patterns find what looks like a secret, and structure confirms what is one.

Three plain kinds come from patterns alone: ``assign`` (a name such as ``token`` given a value), ``access`` (access key
ids) and ``hex`` (long runs of hex digits). Two kinds need proof: runs of base64 (also the url alphabet, also over several
lines) and of hex are decoded wherever a key can start, and reported as ``key`` only if nested lengths add up to a private
key: PKCS#1, SEC1, PKCS#8 and its encrypted form, or an OpenSSH container. A ``jwt`` is a signed token whose header is a
JSON object that names an algorithm, whose payload is a JSON object and whose signature has the size of that algorithm.
Public keys, certificates, unsigned tokens and random text of the same alphabet are left alone.

Whole texts are scanned, whatever their length. A prefilter over a batch of texts leaves out those that hold no
candidate at all; it decides nothing else.

Defined cases: a null or empty text has no spans; spans of one kind never overlap, leftmost first, those of different
kinds may; rows are judged one by one, so repeated rows get equal results and an empty table an empty one. Columns of the
caller stay, whatever their names; a column called like the result is replaced.
"""

from __future__ import annotations

import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans of one start are listed.
PLAIN = ("assign", "access", "hex")
KINDS = (*PLAIN, "key", "jwt")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}(?:(?:\r?\n|\\r\\n|\\n)[A-Za-z0-9+/_-]+)*")
_SEGMENT = re.compile(r"(?:\r?\n|\\r\\n|\\n)")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{48,}")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{16,}")
_OPENING = re.compile(r"ey[A-P]")
_REST = re.compile(r"\.(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")

#: What a text needs to hold for the patterns above to find anything; over a batch at once.
_MAY_HOLD = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "base64": r"[A-Za-z0-9+/_-]{24}",
    "hexkey": r"[0-9A-Fa-f]{48}",
    "jwt": r"[A-Za-z0-9_-]{16}\.ey",
}

# Fixed values of the formats: tags, the object identifier that all password-based schemes share, the container's magic
# and the bytes of a signature by algorithm (the least number for those that depend on the key).
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_PASSWORD_BASED = bytes.fromhex("2a864886f70d01")
_OPENSSH = b"openssh-key-v1\0"
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
_SIGNATURE_LEAST = {"RS": 128, "PS": 128}


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte of the content, byte behind it) of the element at ``at``; None if it doesn't fit before ``end``."""
    if end - at < 2:
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 3 or end - start < width:
            return None
        n = int.from_bytes(data[start : start + width], "big")
        start += width
        if n < 0x80 or n >> (8 * (width - 1)) == 0:  # a shorter form would do
            return None
    return (tag, start, start + n) if start + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at`` to ``end`` exactly, or None."""
    found = []
    while at < end:
        if not (one := element(data, at, end)):
            return None
        found.append(one)
        at = one[2]
    return found


def private_key(data: bytes) -> int | None:
    """The bytes of the private key in DER that ``data`` starts with, or None."""
    outer = element(data, 0, len(data))
    if not outer or outer[0] != _SEQUENCE or not (parts := elements(data, outer[1], outer[2])):
        return None
    tags = [tag for tag, _, _ in parts]
    size = [stop - start for _, start, stop in parts]
    if tags[0] == _INTEGER and size[0] == 1 and data[parts[0][1]] <= 1:
        if len(parts) >= 9 and set(tags[:9]) == {_INTEGER} and size[1] >= 64:  # PKCS#1: version and eight numbers
            return outer[2]
        if data[parts[0][1]] == 1 and tags[1:2] == [_OCTETS] and 16 <= size[1] <= 72:  # SEC1
            return outer[2]
        if tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS#8: an algorithm, then an encoded key
            algorithm, inner = elements(data, *parts[1][1:]), elements(data, *parts[2][1:])
            if algorithm and algorithm[0][0] == _OID and inner and len(inner) == 1 and inner[0][0] in (_SEQUENCE, _OCTETS, _INTEGER):
                return outer[2]
    elif tags == [_SEQUENCE, _OCTETS]:  # PKCS#8 under a password
        algorithm = elements(data, *parts[0][1:])
        if algorithm and algorithm[0][0] == _OID and data.startswith(_PASSWORD_BASED, algorithm[0][1]) and size[1] >= 16:
            return outer[2]
    return None


def openssh_key(data: bytes) -> int | None:
    """The bytes of the OpenSSH container that ``data`` starts with, or None."""

    def string(at: int) -> int:
        """The byte behind the counted string at ``at``; 0 if it doesn't fit."""
        stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return stop if at + 4 <= len(data) and stop <= len(data) else 0

    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)
    for _ in range(3):  # cipher, derivation, its options
        if not (at := string(at)):
            return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= len(data) // 4:
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        if not (at := string(at)):
            return None
    return at


def _decode(chars: str) -> bytes:
    """Base64 of either alphabet without padding; bits beyond the last whole byte are dropped."""
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return binascii.a2b_base64(chars.replace("-", "+").replace("_", "/") + "=" * (-len(chars) % 4))


#: Base64 of a sequence's first byte, or of the container's magic.
_KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE")


def _keys_in_base64(text: str) -> Iterator[tuple[int, int]]:
    for run in _BASE64_RUN.finditer(text):
        parts, n, starts, places, at = [], 0, [], [], run.start()
        for cut in [*_SEGMENT.finditer(text, run.start(), run.end()), None]:
            stop = cut.start() if cut else run.end()
            starts.append(n)
            places.append(at)
            parts.append(text[at:stop])
            n += stop - at
            at = cut.end() if cut else stop
        chars = "".join(parts)
        place = lambda k: places[i := bisect_right(starts, k) - 1] + k - starts[i]
        done = 0
        for m in _KEY_START.finditer(chars):
            k = m.start()
            if k < done:
                continue
            if chars[k] == "M":
                head = _decode(chars[k : k + 16])
                outer = element(head + bytes(3), 0, 1 << 24)  # its length alone; the content comes next
                if not outer or head[outer[1] : outer[1] + 1] not in (b"\x02", b"\x30") or k + -(-outer[2] * 4 // 3) > len(chars):
                    continue
                size = private_key(_decode(chars[k : k + -(-outer[2] * 4 // 3)]))
            else:
                size = openssh_key(_decode(chars[k:]))
            if size:
                done = k + -(-size * 4 // 3)
                yield place(k), place(done - 1) + 1


_HEX_KEY_START = re.compile(r"30(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4})(?:02010[01]|30)")


def _keys_in_hex(text: str) -> Iterator[tuple[int, int]]:
    for run in _HEX_RUN.finditer(text):
        digits, at = run[0].lower(), 0
        while m := _HEX_KEY_START.search(digits, at):
            at = m.start() + 1
            outer = element(bytes.fromhex(digits[m.start() : m.start() + 8]) + bytes(2), 0, 1 << 24)
            if outer and 2 * outer[2] <= len(digits) - m.start() and (size := private_key(bytes.fromhex(digits[m.start() : m.start() + 2 * outer[2]]))):
                at = m.start() + 2 * size
                yield run.start() + m.start(), run.start() + at


def _object(data: bytes) -> dict | None:
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _signed(header: dict | None, payload: bytes, signature: bytes) -> bool:
    alg = header.get("alg") if header else None
    if not isinstance(alg, str) or _object(payload) is None:
        return False
    return len(signature) == _SIGNATURE[alg] if alg in _SIGNATURE else len(signature) >= _SIGNATURE_LEAST.get(alg[:2], 1 << 30)


def _headers(run: str) -> Iterator[tuple[int, dict]]:
    """(start, object) of each JSON object in base64 that ends where ``run`` ends. Each alignment is decoded once and read
    in place, so a run of any length costs its length."""
    parse, decoded = json.JSONDecoder().raw_decode, {}
    for m in _OPENING.finditer(run):
        lead = m.start() % 4
        if lead not in decoded:
            decoded[lead] = _decode(run[lead:]).decode("latin-1")
        at = (m.start() - lead) // 4 * 3
        try:
            found, stop = parse(decoded[lead], at)
        except (ValueError, RecursionError):
            continue
        if stop == len(decoded[lead]) and isinstance(found, dict):
            yield m.start(), found


def _signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for run in _TOKEN.finditer(text):
        if run.start() < done or not text.startswith(".ey", run.end()) or not (rest := _REST.match(text, run.end())):
            continue
        for start, header in _headers(run[0]):  # the header may follow other characters of its alphabet
            if _signed(header, _decode(rest[1]), _decode(rest[2])):
                done = rest.end()
                yield run.start() + start, done
                break


def spans_of(text: str, among: frozenset[str] = frozenset(_MAY_HOLD)) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. ``among`` names the candidates that may be in the text."""
    found = []
    if "assign" in among:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in among:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if "hex" in among:
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if among & {"base64", "hexkey"}:
        keys = sorted({*(_keys_in_base64(text) if "base64" in among else ()), *(_keys_in_hex(text) if "hexkey" in among else ())})
        found += [("key", *s) for i, s in enumerate(keys) if not i or s[0] >= keys[i - 1][1]]
    if "jwt" in among:
        found += [("jwt", *s) for s in _signed_tokens(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan_batch(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("")
    may = {name: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) for name, pattern in _MAY_HOLD.items()}
    rows: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in sorted({int(i) for hit in may.values() for i in hit.nonzero()[0]}):
        own = frozenset(name for name, hit in may.items() if hit[i])
        rows[i] = [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(texts[i].as_py(), own)]
    return pa.array(rows, _ARROW)


def scan(docs: DataFrame, text: str = "text", result: str = "secrets") -> DataFrame:
    """``docs`` with an array of (kind, start, end), in code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _scan_batch(batch)

    return docs.withColumn(result, found(docs[f"`{text}`"].cast("string")))


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by ``mask``; other texts stay as they are."""

    @F.arrow_udf(T.StringType())
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = batch.to_pylist()
            for i, spans in enumerate(_scan_batch(batch).to_pylist()):
                whole, at, parts = out[i], 0, []
                for s in spans:
                    if s["start"] >= at:
                        parts += [whole[at : s["start"]], mask]
                    at = max(at, s["end"])
                if spans:
                    out[i] = "".join([*parts, whole[at:]])
            yield pa.array(out, pa.string())

    return docs.withColumn(text, masked(docs[f"`{text}`"].cast("string")))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of the given kinds, comma-joined, in their order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
