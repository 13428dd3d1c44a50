"""Secret scans judged by corpus-wide ownership frequency.

Every text is searched for candidates. Each candidate's hash is then counted over the whole
corpus: in how many repositories (documents) and with how many owners (sources) it stands. A
value with one owner is live-looking; one that several owners carry is a copied example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, map_texts

# fixed values: the three base kinds, in the order that breaks ties of equal start
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGNED = 6
# a candidate of the added kind: a long run of key characters with three kinds of them
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5
#: A value that more owners than this carry is a copied example.
MAX_OWNERS = 1

Span = tuple[int, str, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, value) of the base kinds by start, then kind as listed."""
    found = [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    found += [(m.start(), "access", m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def entropy(value: str) -> float:
    """Bits per character of a value's own letter frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Random-looking runs that no base span touches; the corpus decides about them."""
    taken = [(s[0], s[2]) for s in base]
    found = []
    for m in _RUN.finditer(text):
        value = m[0]
        mixed = re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)
        if mixed and entropy(value) >= MIN_ENTROPY and all(m.end() <= a or b <= m.start() for a, b in taken):
            found.append((m.start(), "owned", m.end(), value))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


_FOUND = "array<struct<start:long,kind:string,end:long,value:string>>"


def _scan(batch: pa.RecordBatch) -> dict:
    out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base", "base_sha256", "found")}
    for text in batch.column("text").to_pylist():
        base = base_spans(text or "")
        kinds = Counter(s[1] for s in base)
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(kinds[kind])
        out["base"].append(joined(base))
        out["base_sha256"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
        spans = base + candidates(text or "", base)
        out["found"].append(
            [(start, kind, end, hashlib.sha256(value.encode()).hexdigest()) for start, kind, end, value in spans]
        )
    found = pa.array(
        [[dict(zip(("start", "kind", "end", "value"), s, strict=True)) for s in spans] for spans in out["found"]],
        pa.list_(pa.struct({"start": pa.int64(), "kind": pa.string(), "end": pa.int64(), "value": pa.string()})),
    )
    rest = {k: v for k, v in out.items() if k != "found"}
    return rest | {"found": found, "doc_id": batch.column("doc_id"), "source": batch.column("source")}


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, and the columns of ``keep``, which are carried along).

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (hash of the base spans), spans
    (base spans and the added ``owned`` ones, by start), secrets (start, end, kind, live of
    each), n_live and n_examples (spans whose value one owner holds, or several).

    An ``owned`` candidate becomes a span only if its value belongs to one owner; base spans
    always stay and are only judged. A null text is empty, a null source is one owner of its own
    name, repeated rows count once for their owner. An empty table gives no rows. Values are
    compared by SHA-256, so no secret is shuffled or stored in the clear unless ``keep`` names
    the text. Spans stay with their row, whatever its doc_id.
    """
    kept = Kept(docs.sparkSession, "secrets")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    carried = [c for c in keep if c != "doc_id"]
    schema = "doc_id long, source string, n_assign long, n_access long, n_hex long, base string, base_sha256 string"
    schema = ", ".join([schema, f"found {_FOUND}", *(f"`_keep_{c}` {fields[c]}" for c in carried)])

    def scan(batch: pa.RecordBatch) -> dict:
        return _scan(batch) | {f"_keep_{c}": batch.column(c) for c in carried}

    rows = kept(map_texts(docs, [*dict.fromkeys(("doc_id", "source", "text", *keep))], schema, scan).withColumn("_row", F.expr("uuid()")))
    hits = rows.select("_row", "doc_id", F.coalesce("source", F.lit("\x00")).alias("owner"), F.explode("found").alias("f"))
    hits = hits.select("_row", "doc_id", "owner", "f.*")
    # owners and repositories per value: combined before each shuffle, so a value in a third of all rows is one row
    per_owner = hits.groupBy("value", "owner").agg(F.count_distinct("doc_id").alias("n"))
    facts = per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    judged = hits.join(facts, "value").withColumn("live", F.col("owners") <= MAX_OWNERS)
    judged = judged.filter((F.col("kind") != "owned") | F.col("live"))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2)
    per_row = judged.groupBy("_row").agg(
        F.sort_array(
            F.collect_list(F.struct("start", order.alias("o"), "kind", "end", "live", "owners", "repositories"))
        ).alias("secrets")
    )
    base = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", *(f"_keep_{c}" for c in carried)]
    with_hits = rows.filter(F.size("found") > 0).select("_row", *base).join(per_row, "_row", "left").drop("_row")
    without = rows.filter(F.size("found") == 0).select(*base, F.lit(None).cast(per_row.schema["secrets"].dataType).alias("secrets"))
    text = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return with_hits.unionByName(without).select(
        *base[:5], *(F.col(f"_keep_{c}").alias(c) for c in carried), F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"), "secrets",
        F.coalesce(F.size(F.filter("secrets", lambda s: s["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("secrets", lambda s: ~s["live"])), F.lit(0)).cast("long").alias("n_examples"),
    )


def mask_spans(text: Column, spans: Column, with_text: str = "[SECRET]") -> Column:
    """Text with each span (start, end; ordered, may overlap) replaced once per stretch."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        new = F.concat(state["out"], gap, F.lit(with_text))
        return F.struct(
            F.when(span["start"] >= state["at"], new).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    done = F.aggregate(spans, start, step)
    masked = F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, masked).otherwise(text)
