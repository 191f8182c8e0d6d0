"""Secret scans (operator 7).

Method: zstandard novelty with primed dictionaries.  A candidate string in a
sensitive context is appended to its surrounding text and both are compressed
with a dictionary of code and identifiers; the growth is the candidate's
marginal size.  Words, names and code are cheap, as the dictionary or the
surroundings hold their parts; random keys cost nearly all their bytes.

The fixed kinds (assign, access, hex) are found by pattern and always kept; the
method adds spans of kind ``novel`` for strings that no pattern covers.  Null
texts are empty, empty texts have no spans; offsets are code points, ends
exclusive.  Very long texts are scanned whole, and only ``AROUND`` characters
beside a candidate are compressed.  Repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrow import sha256_hex
from wayfold.llm.store import documents

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, alone or as parts of identifiers, and how far from a candidate they count.
#: Words that are parts of plain words, too, have to stand between separators or humps.
CONTEXT = re.compile(
    r"(?i:bearer|credential|passphrase|passwd|password|private|pwd|secret|signature|token|(?:api|access|auth|client|encryption|master|session|signing|ssh)[_-]?key|\bauth)"
    r"|(?<![A-Za-z])(?:auth[a-z]*|key|keys|pass)(?![a-z])|(?:Auth[a-z]*|Key|Keys|Pass)(?![a-z])|(?<![A-Z])(?:AUTH[A-Z]*|KEY|KEYS|PASS)(?![A-Za-z])|(?i:\bkey\b)",
    re.ASCII,
)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_CANDIDATE = 20
PART = re.compile(r"[^=]+=*")
AROUND = 256
#: A candidate is reported when it adds at least this share of its own bytes.
NOVEL_SHARE = 0.62

#: What code and identifiers look like; the dictionary that compression is primed with.
PRIMER = """
def class return import from self None True False if else elif for while try except finally with as lambda yield raise
public private protected static final void int long double float boolean String new null true false this super extends implements interface package
function const let var async await export default require module exports undefined typeof instanceof
SELECT FROM WHERE GROUP BY ORDER HAVING INSERT INTO VALUES UPDATE DELETE JOIN LEFT RIGHT INNER OUTER CREATE TABLE INDEX
username password_hash user_id session_id request_id access_token refresh_token client_id client_secret api_key secret_key private_key
getConfiguration setConfiguration configuration authentication authorization certificate credentials environment production development staging
http https www com org net localhost example index html json yaml xml config settings application service controller repository
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 1234567890 deadbeef
test_ example_ sample_ placeholder your_token_here changeme xxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaa ---------------- ================ ________________
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les de des du et en un une que qui dans pour par sur plus est pas avec au aux ce cette il elle
el la los las de que y en un una por con para como su al lo se del mas pero sus
"""


class Scanner:
    """The scanner of a Python worker."""

    def __init__(self):
        import zstandard

        primer = zstandard.ZstdCompressionDict(PRIMER.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.packer.compress(text.encode("utf-8", "replace")))

    def marginal(self, text: str, start: int, end: int) -> float:
        """Bytes that the span adds to what stands around it, other copies of it left out, per byte of the span."""
        piece, reach = text[start:end], AROUND + end - start  # a copy that the reach cuts lies beyond AROUND
        blank = "\0" * len(piece)
        before = text[max(0, start - reach) : start].replace(piece, blank)[-AROUND:].replace("\0", "")
        after = text[end : end + reach].replace(piece, blank)[:AROUND].replace("\0", "")
        with_it = self.size(before + after + "\n" + piece)
        return (with_it - self.size(before + after + "\n")) / len(piece)

    @staticmethod
    def base(text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed kinds, sorted."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    @staticmethod
    def candidates(text: str) -> list[tuple[int, int]]:
        """Spans of candidates; names and values that "=" joins stand apart where a part is long enough."""
        found = []
        for m in CANDIDATE.finditer(text):
            parts = [p.span() for p in PART.finditer(text, *m.span())]
            found += [p for p in parts if p[1] - p[0] >= LEAST_CANDIDATE] or [m.span()]
        return found

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """All places of incompressible strings that stand in a sensitive context once at least and that no fixed kind touches."""
        starts, furthest, found = [s for s, _, _ in base], [], []
        for _, _, end in base:
            furthest.append(max(end, furthest[-1] if furthest else 0))
        places: dict[str, list[tuple[int, int]]] = {}
        for s, e in self.candidates(text):
            i = bisect_right(starts, e - 1)
            if i and furthest[i - 1] > s:
                continue
            places.setdefault(text[s:e], []).append((s, e))
        for piece, spans in places.items():
            if sum(map(bool, (re.search("[a-z]", piece), re.search("[A-Z]", piece), re.search("[0-9]", piece)))) < 2:
                continue
            # a long candidate is measured in full, whatever its length
            if any(CONTEXT.search(text, max(0, s - REACH), e + REACH) and self.marginal(text, s, e) >= NOVEL_SHARE for s, e in spans):
                found += [(s, 3, e) for s, e in spans]
        return found

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.novel(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the fixed kinds, and all spans as kind, start, end, base and marginal share."""

    def run(batches):
        scanner = Scanner()
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            counts, every, base_hex, text_of = [[], [], []], [], [], []
            for x in batch.column(1):
                text = (x.as_py() or b"").decode("utf-8", "replace")
                base, spans = scanner.spans(text)
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in base))
                every.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                base_hex.append(sha256_hex(joined(base).encode()))
                text_of.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_hex, pa.string()), pa.array(text_of, pa.string()), pa.array(every, pa.list_(span))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "*") -> DataFrame:
    """doc_id and text with every found span masked, its length kept."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = (x.as_py() or b"").decode("utf-8", "replace")
                pieces, at = [], 0
                for s, _, e in scanner.spans(text)[1]:
                    if e > at:
                        pieces += [text[at:s], mask * (e - max(s, at))]
                        at = e
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("found")
