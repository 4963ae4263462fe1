"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.tokens import chunks

#: The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "provider", "owned"]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Formats that name their issuer, and any long run that may be a credential.
PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|sk-[A-Za-z0-9_-]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
HINTS = ("gh", "xox", "eyJ", "sk-", "-----BEGIN")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.2
#: A value is a widely copied example with so many owners, or so large a share of all owners if that is fewer (two at least), or in so many
#: different texts whoever owns them.
OWNERS, SHARE, TEXTS = 10, 0.5, 1000


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates that no base span overlaps: issuers' formats, and runs with letters, digits and enough entropy."""
    taken, out = [(s, e) for s, _, e, _ in base], []
    free = lambda s, e: all(e <= a or b <= s for a, b in taken)
    if any(h in text for h in HINTS):
        for m in PROVIDER.finditer(text):
            if free(*m.span()):
                out.append((m.start(), 3, m.end(), m[0]))
                taken.append(m.span())
    for m in RUN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and free(*m.span()) and entropy(v) >= LEAST_ENTROPY:
            out.append((m.start(), 4, m.end(), v))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def hashed(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


SCANNED = "row long, doc_id long, text_hash long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:long>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            text = text or ""
            base = base_spans(text)
            kinds = Counter(k for _, k, _, _ in base)
            sha = hashlib.sha256(join_spans([x[:3] for x in base]).encode()).hexdigest()
            found = [(s, k, e, hashed(v)) for s, k, e, v in base + more_spans(text, base)]
            rows.append((kinds[0], kinds[1], kinds[2], sha, found))
        out = b[["row", "doc_id", "text_hash", "owner", "repo"]].reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"])], axis=1)


def scan(docs: DataFrame, owner: str = "source", repo: str = "source") -> DataFrame:
    """One row for each row of docs, with its base counts and all candidate spans."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text")
    return d.mapInPandas(_scan, SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, texts) of candidates (hash, text_hash, owner, repo). A text that is copied counts once, for its smallest owner and repository.

    Rows are summed by text and by owner and repository first, so that a value that a third of all rows holds meets as a few rows.
    """
    each = found.groupBy("hash", "text_hash").agg(F.min("owner").alias("owner"), F.min("repo").alias("repo"))
    each = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("texts"))
    return each.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.sum("texts").alias("texts"))


def exploded(s: DataFrame) -> DataFrame:
    """A row for each candidate span of scanned rows."""
    return s.where(F.size("found") > 0).select("row", "text_hash", "owner", "repo", F.explode("found").alias("f")).select("row", "text_hash", "owner", "repo", "f.*")


def judged(s: DataFrame) -> DataFrame:
    """(hash, live) of all candidate values of scanned rows: whether each is no widely copied example."""
    wide = max(2, min(OWNERS, math.ceil(SHARE * s.select("owner").distinct().where("owner is not null").count())))
    return ownership(exploded(s)).select("hash", ((F.col("owners") < wide) & (F.col("texts") < TEXTS)).alias("live"))


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "source") -> DataFrame:
    """One row for each row of docs: base counts, and found, an array of (start, kind, end, live) by start and kind.

    Base spans and issuers' formats always stay; other runs stay if they are owner-specific. live: the value is no widely copied
    example by OWNERS, SHARE and TEXTS. Null texts are empty, null owners count as no owner, copies of a text count once. An empty table gives an empty result.
    """
    s = settle(scan(docs, owner, repo), "spans")
    spans = exploded(s).join(judged(s), "hash").where(F.col("live") | (F.col("kind") < KINDS.index("owned")))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("kept"))
    return s.join(by_row, "row", "left").select("row", "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("kept", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("found", lambda f: F.concat_ws(":", F.get(names, f.kind), f.start, f.end)), ",")
    live = F.size(F.filter("found", lambda f: f.live)).cast("long")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), live.alias("n_live"), (F.size("found") - live).alias("n_example"))


#: What live values become; copied examples that tasks hold at most, beyond which spans are joined.
MASK, EXAMPLES = "<secret>", 1_000_000


def masked(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text with its spans, joined where they overlap, replaced by MASK."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def _with_texts(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts, and n_chars of those that changed if there is such a column."""
    i, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
    if n >= 0:
        old = b.column(i).to_pylist()
        size = [len(y) if x != y else k for x, y, k in zip(old, texts, b.column(n).to_pylist(), strict=True)]
        b = b.set_column(n, b.schema.field(n), pa.array(size, b.schema.field(n).type))
    return b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))


def mask_secrets(docs: DataFrame, owner: str = "source", repo: str = "source", examples: int = EXAMPLES) -> DataFrame:
    """docs with live-looking secrets masked in text, and n_chars, if there is one, as the text now is; copied examples and all other rows as they were.

    Tasks scan again and hold the few values that are copied examples; if there are more than `examples`, live spans are joined to their texts.
    """
    s = settle(scan(docs, owner, repo), "spans")
    known = settle(judged(s), "values")
    copied = known.where("not live").select("hash")
    if copied.count() <= examples:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in copied.collect()))  # bounded by examples

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                texts = b.column("text").to_pylist()
                for i, text in enumerate(texts):
                    if text and (base := base_spans(text)) + (found := more_spans(text, base)):
                        texts[i] = masked(text, [(s, e) for s, _, e, v in base + found if hashed(v) not in sent.value])
                yield _with_texts(b, texts)

        return docs.mapInArrow(run, docs.schema)
    live = exploded(s).join(known.where("live"), "hash").groupBy("text_hash").agg(F.collect_set(F.struct("start", "end")).alias("live"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("text_hash")).join(live, "text_hash", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pa.RecordBatch.from_struct_array(b.column("doc"))
            texts = [masked(t, [(x["start"], x["end"]) for x in f]) if t and f else t for t, f in zip(doc.column("text").to_pylist(), b.column("live").to_pylist(), strict=True)]
            yield _with_texts(doc, texts)

    return d.select("doc", "live").mapInArrow(apply, docs.schema)
