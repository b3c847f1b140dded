"""Secret scan: pattern rules, then dictionary-primed zstandard novelty.

The base rules find assignments, access keys and hex strings. The novelty method
looks on both sides of every sensitive word (password, token, ...) for strings that
are no plain words (letters of one case are none from 24 letters on) and measures what each adds to the compressed size of the text
around it, by a compressor primed with a dictionary of code and identifiers. A
string that costs almost its full entropy is new to both text and dictionary, so
it is reported: names, versions and repeated constants are not. A candidate that
base spans cover is not measured; one that reaches beyond them is.

Offsets are code points, ends exclusive. Spans are ordered by start, then kind as
in ``KINDS``. Defined results: a null text is empty and has no spans; repeated
rows get equal results; texts of any length are scanned whole, in time linear in
their length. Extra columns pass through untouched; one that has the name of an
output column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

KINDS = ("assign", "access", "hex", "novel")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The base patterns.
ASSIGN = re.compile(
    f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token')))}|{_either_case('api')}_?{_either_case('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

#: Words that make their surroundings sensitive (fixed values).
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "api key", "credential", "private_key", "private key", "access_key", "access key", "auth_key", "bearer", "authorization", "client_id", "signing_key")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Candidates are runs without space, quotes, brackets and separators; an equals sign may only pad the end.
CANDIDATE = re.compile(r"""[^\s"'`<>()\[\]{},;:=\\|]+={0,2}""")
_TRIM = ".!?*_~-"
REACH = 64
CONTEXT = 256
#: A candidate has at least so many bits of entropy, if drawn from its own alphabet: 18 digits, or 10 letters and digits of both cases.
MIN_BITS = 59.0
#: Letters of one case may be a word, however new: they need as much as 24 of them have, more than words have, and cost all of it.
LETTER_BITS, LETTER_NOVELTY = 112.0, 1.0
#: A candidate is incompressible if it costs this share of the entropy of its own alphabet.
NOVELTY = 0.9

#: Code and identifier words that prime the compressor (fixed values).
DICTIONARY = """
abstract access account action address admin algorithm alias allow api application argument array assert async attribute auth authorization await
base64 bearer begin boolean branch break bucket buffer build byte cache callback case catch certificate channel char class client cluster code column command
commit config connection console const constructor container content context continue cookie count create credential crypto current data database date debug
default define delete deploy description dev digest directory disable docker domain double download driver else email enable encoding encrypt endpoint entity
enum environment error event exception exec export extends false field file filter final float folder format function generate get global group handler hash
header host html http https identifier if import include index info init input insert instance int interface internal invalid item iterator json key keyword
label lambda length level library limit list load local localhost lock log login logout long main manager map master message method model module mutex name
namespace network new node null number object offset online option order output package page param parse passphrase password path pattern payload permission
pointer policy pool port prefix primary print private process production profile project property protected protocol provider proxy public query queue random
range read record redirect region register release remote remove replace request require resource response result return role root route row runtime schema
script secret security select self server service session set setting sha1 sha256 signature size socket source sql stack state static status storage stream
string struct style suffix super switch system table tag target task template test text this thread throw time timeout timestamp title token topic trace
transaction true try type undefined union update upload uri url user username utf8 uuid value variable vector version view virtual void volatile while worker
write www xml yaml example placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
""".encode()


class Novelty:
    """Marginal compressed bytes of a string in its context."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 12):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def marginal(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode("utf-8", "surrogatepass")
        return len(self.compress(around + candidate.encode())) - len(self.compress(around))

    def is_novel(self, before: str, candidate: str, after: str, share: float = NOVELTY) -> bool:
        """Whether the candidate's marginal cost is near the entropy of a random string over its alphabet."""
        least = MIN_BITS
        if plain(candidate):
            if not candidate.isalpha():
                return False
            least, share = LETTER_BITS, LETTER_NOVELTY
        bits = len(candidate) * alphabet_bits(candidate)
        return bits >= least and self.marginal(before, candidate, after) * 8 >= share * bits


_CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[^0-9A-Za-z]"), 8))


def alphabet_bits(candidate: str) -> float:
    """Bits a character of a random string over the candidate's kinds of characters."""
    if re.fullmatch("(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)", candidate) and not candidate.isdecimal():
        return 4.0
    return math.log2(sum(n for kind, n in _CLASSES if kind.search(candidate)))


_PART = re.compile(r"[^\W_]+")
_WORDY = re.compile(r"(?:[^\W\d_]?(?:(?![A-Z])[^\W\d_])*|[A-Z]+)\d{0,4}|\d{1,8}")


def plain(candidate: str) -> bool:
    """Whether all parts are words of one case (with a short number at most), dates and the like, or joined words as in camelCase."""
    for part in _PART.findall(candidate):
        if _WORDY.fullmatch(part):
            continue
        rises = sum(a.islower() and b.isupper() for a, b in zip(part, part[1:]))
        if not part.isalpha() or rises * 4 >= len(part):
            return False
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _regions(low: str) -> list[tuple[int, int]]:
    """Merged surroundings of the sensitive words."""
    found: list[tuple[int, int]] = []
    for word in _SENSITIVE.finditer(low):
        lo, hi = max(0, word.start() - REACH), word.end() + REACH
        if found and lo <= found[-1][1]:
            found[-1] = (found[-1][0], hi)
        else:
            found.append((lo, hi))
    return found


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Spans that the novelty method adds; none lies within base spans."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the offsets
        low = text.translate(_ASCII_LOWER)
    if not any(w in low for w in SENSITIVE):
        return []
    taken: list[tuple[int, int]] = []
    for s, e, _ in sorted(base):
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    found: dict[int, int] = {}
    upto = at = 0
    for lo, hi in _regions(low):
        lo = max(lo, upto)
        while lo > upto and CANDIDATE.match(text, lo - 1, lo):  # to the start of the run that the region cuts
            lo -= 1
        while lo < hi:
            m = CANDIDATE.search(text, lo)
            if m is None or m.start() >= hi:
                break
            upto = lo = m.end()
            start, end = m.start(), m.end()
            while start < end and text[start] in _TRIM:
                start += 1
            while start < end and text[end - 1] in _TRIM:
                end -= 1
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if start == end or (at < len(taken) and taken[at][0] <= start and end <= taken[at][1]):
                continue
            candidate = text[start:end]
            if novelty.is_novel(text[max(0, start - CONTEXT) : start], candidate, text[end : end + CONTEXT]):
                found[start] = end
    return [(s, e, "novel") for s, e in found.items()]


def all_spans(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    more = novel_spans(text, base, novelty)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCANNED = "secrets array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, n_hex long, base_sha256 string"


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all), the spans and the base counts; with ``redact`` also ``redacted_text``.

    ``redacted_text`` is null where the text is. Map-only: no shuffle.
    """
    shield = common.Shield(docs)
    cols = shield.columns if keep is None else [shield.at[c] for c in keep]
    rows, name = common.with_text(shield.rows, cols, shield.at[text])
    schema = common.schema_of(rows, cols, SCANNED + (", redacted_text string" if redact else ""))
    names = [*cols, "secrets", "n_assign", "n_access", "n_hex", "base_sha256", *(["redacted_text"] if redact else [])]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tool(None)
        novelty = Novelty()
        for batch in (part for whole in batches for part in common.text_chunks(whole, name)):
            texts = batch.column(name).to_pylist()
            found = [all_spans(t or "", novelty) for t in texts]
            made = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in every] for _, every in found], span_type)]
            made += [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS[:3]]
            made.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            if redact:
                made.append(pa.array([None if t is None else redacted(t, every) if every else t for t, (_, every) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), *made], names=names)

    return shield.back(rows.mapInArrow(run, schema), keep)


def spans_string() -> F.Column:
    """All spans of a row as kind:start:end, comma-joined."""
    return F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
