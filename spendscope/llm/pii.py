"""Personal data by rules and by bootstrapped contexts; DataFrame functions only.

Rules find e-mail addresses, IP addresses, card and phone numbers; these base spans always stay. They are the seeds of a
bootstrap: the words before and after them are lexical patterns, and every other word that holds a digit or an
at sign is a candidate. Patterns and strings form a graph, scored round by round: a pattern's confidence in a kind
is the mean score of the strings it stands with, a string's score the likeliest of its patterns. Where a pattern stands
with ``LEAST_SEEDS`` different seeds and its confidence ends at ``LEAST_CONFIDENCE`` or more, the candidates beside it are
spans of that kind too, unless they touch a base span.

Expressions: matches come from ``regexp_extract_all``, what lies between them from ``split``, so the places are prefix
sums of lengths. The regular expressions are possessive, so long runs cost linear time and no stack; they match what
the plain forms match. Prefix sums go by blocks of ``STRIDE``, so a text with very many matches isn't quadratic.

Defined cases: a null text is empty and has no span; repeated rows get the same answer; rows with one doc_id and
different texts each get their own; other columns are not read. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions.joins import checked_broadcast
from spendscope.llm.common import settle

KINDS = ["email", "ip", "card", "phone"]
#: A local part begins where no such character stands before it, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
EDGES = "\"'()[]{}<>.,;:!?"
#: Code points before and after a span in which its neighbouring words are looked for.
CONTEXT = 64
LEAST_SEEDS, LEAST_CONFIDENCE, ROUNDS = 5, 0.8, 3
STRIDE = 256
SPANS = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def prefix_sums(values: Column) -> Column:
    """Sum of all earlier elements, for each element."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    numbers = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)))
    blocks = F.filter(numbers, lambda i: i % STRIDE == 0)
    sums = F.transform(blocks, lambda i: F.aggregate(F.slice(values, i + 1, STRIDE), zero, add))
    before = F.transform(blocks, lambda i: F.aggregate(F.slice(sums, F.lit(1), (i / STRIDE).cast("int")), zero, add))
    return F.transform(
        values,
        lambda _, i: F.element_at(before, (F.floor(i / STRIDE) + 1).cast("int")) + F.aggregate(F.slice(values, i - i % STRIDE + 1, i % STRIDE), zero, add),
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(text, 1, CONTEXT), r"^\s*+(\S++)", 1))


def _last_word(text: Column) -> Column:
    return F.lower(F.reverse(F.regexp_extract(F.reverse(F.substring(text, -CONTEXT, CONTEXT)), r"^\s*+(\S++)", 1)))


def _located(rows: DataFrame, hits: str, pattern: str, out: str) -> DataFrame:
    """Column ``out``: array of (start, end, value, before, after) of the matches in column ``hits``."""
    gaps, at = f"{hits}_gaps", f"{hits}_at"
    some = F.size(hits) > 0
    rows = rows.withColumn(gaps, F.when(some, F.split("text", pattern, -1)))
    sums = prefix_sums(F.zip_with(F.col(hits), F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: (F.length(h) + F.length(g)).cast("long")))
    rows = rows.withColumn(at, F.when(some, sums))

    def place(h: Column, i: Column) -> Column:
        start = F.get(at, i) + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value"),
            _last_word(F.get(gaps, i)).alias("before"), _first_word(F.get(gaps, i + 1)).alias("after"),
        )

    return rows.withColumn(out, F.when(some, F.transform(hits, place))).drop(gaps, at, hits)


def _kept(k: int, kind: str) -> Column:
    """The spans of a kind that pass its test, with the kind's number."""

    def numbered(s: Column) -> Column:
        names = ("end", "value", "before", "after")
        return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), *[s[x].alias(x) for x in names])

    spans = F.coalesce(F.col(f"{kind}_spans"), F.array().cast(SPANS))
    return F.transform(F.filter(spans, lambda s: _passes(kind, s["value"])), numbered)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))), 256)


def located(docs: DataFrame) -> DataFrame:
    """Per row: row_key, doc_id, base (kind number, start, end, value, before, after) and the candidates beside them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", row_key())
    none = F.array().cast("array<string>")
    hints = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    digit = F.col("text").rlike("[0-9@]")
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(kind, F.when(hints.get(kind, digit), found).otherwise(none))
    rows = rows.withColumn("other", F.when(digit, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    for kind, pattern in (*PATTERNS.items(), ("other", CANDIDATE)):
        rows = _located(rows, kind, pattern, f"{kind}_spans")
    base = [_kept(k, kind) for k, kind in enumerate(KINDS)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))

    def trimmed(s: Column) -> Column:
        cut = F.ltrim(s["value"], F.lit(EDGES))
        start = s["start"] + F.length(s["value"]) - F.length(cut)
        value = F.rtrim(cut, F.lit(EDGES))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["before"].alias("before"), s["after"].alias("after"))

    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    other = F.filter(F.transform(F.coalesce("other_spans", F.array().cast(SPANS)), trimmed), lambda s: (s["end"] > s["start"]) & free(s))
    return rows.select("row_key", "doc_id", "base", other.alias("other"))


def _edges(rows: DataFrame, spans: str, kind: Column) -> DataFrame:
    """(kind, string, pattern): a row for either neighbour of each span."""
    s = rows.select(F.explode(spans).alias("s"))
    sides = F.explode(F.array(F.concat(F.lit("<"), F.col("s.before")), F.concat(F.lit(">"), F.col("s.after"))))
    return s.select(kind.alias("kind"), F.lower("s.value").alias("string"), sides.alias("pattern")).filter(F.length("pattern") > 1)


def confident_patterns(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the bootstrap trusts in the end."""
    edges = _edges(rows, "base", F.col("s.kind")).union(_edges(rows, "other", F.lit(-1)))
    edges = settle(edges.groupBy("kind", "string", "pattern").agg(F.count("*").alias("n")), "pattern-graph")
    weight = edges.groupBy("pattern").agg(F.sum("n").alias("weight"))
    seeds = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("n").cast("double").alias("mass"))
    seeds = settle(seeds.filter(F.col("seeds") >= LEAST_SEEDS).join(weight, "pattern"), "seeded-patterns")
    others = edges.filter("kind < 0").select("string", "pattern", "n")
    trusted = seeds.select("pattern", "kind", (F.col("mass") / F.col("weight")).alias("confidence"))
    for k in range(rounds):
        strings = others.join(trusted, "pattern").groupBy("string", "kind").agg(F.max("confidence").alias("score"))
        gained = others.join(strings, "string").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("gained"))
        total = seeds.join(gained, ["pattern", "kind"], "left")
        trusted = settle(total.select("pattern", "kind", ((F.col("mass") + F.coalesce("gained", F.lit(0.0))) / F.col("weight")).alias("confidence")), f"round-{k}")
    return trusted.filter(F.col("confidence") >= LEAST_CONFIDENCE)


def discovered(rows: DataFrame) -> DataFrame:
    """row_key and the spans (start, kind, end) that trusted patterns add to the row."""
    s = rows.select("row_key", F.explode("other").alias("s")).select("row_key", "s.start", "s.end", "s.before", "s.after").distinct()
    sides = F.explode(F.array(F.concat(F.lit("<"), F.col("before")), F.concat(F.lit(">"), F.col("after"))))
    met = s.select("row_key", "start", "end", sides.alias("pattern")).join(confident_patterns(rows), "pattern")
    surest = met.groupBy("row_key", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    spans = surest.select("row_key", F.struct("start", (-F.col("best.col2")).cast("int").alias("kind"), "end").alias("span"))
    return spans.groupBy("row_key").agg(F.collect_list("span").alias("added"))  # of one text


def find(docs: DataFrame) -> DataFrame:
    """Per row: row_key, doc_id, base and spans: arrays of (start, kind, end), sorted."""
    rows = settle(located(docs), "located")
    added = settle(discovered(rows), "discovered")
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    out = rows.select("row_key", "doc_id", plain.alias("base")).join(checked_broadcast(added), "row_key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return out.select("row_key", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def spelled(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: counts by kind and digest of the base spans, and all spans."""
    kinds = F.transform("base", lambda b: b["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The table with every span of ``text`` replaced by its kind in brackets; other columns stay as they are."""
    found = find(docs).filter(F.size("spans") > 0).groupBy("row_key").agg(F.first("spans").alias("spans"))
    found = found.select(F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans"))
    rows = docs.withColumn("_key", row_key()).join(checked_broadcast(settle(found, "to-redact")), F.col("_key") == F.col("_row_key"), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_spans", F.lit(1), i), lambda s: s["end"])), F.lit(0).cast("long"))

    def part(s: Column, i: Column) -> Column:
        begin = ends(i)  # of overlapping spans the first names all
        kept = F.substring(F.col("text"), (begin + 1).cast("int"), (s["start"] - begin).cast("int"))
        return F.when(s["start"] >= begin, F.concat(kept, F.get(names, s["kind"]))).otherwise(F.lit(""))

    tail = F.substring(F.col("text"), (ends(F.size("_spans")) + 1).cast("int"), F.length("text"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("_spans", part), ""), tail))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
