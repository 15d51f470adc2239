"""Personal data: seed entities by pattern, then bootstrapped contexts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Kinds in the order of the contract; the method's own kind comes last.
KINDS = ("email", "ip", "card", "phone")
OWN = "id"
#: The contract's patterns, with possessive repeats and look-behinds that find the same matches without retrying inside a run.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"
#: Values that may be identifiers: words of six characters or more with a digit in them.
VALUE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]{6,}+"
GAP = r"[\x20\x09-\x0D]+"
#: The first two words of a text.
HEAD = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)"
#: Seeds beyond the base kinds: unbroken strings of 20 characters or more that mix digits with letters, as keys and tokens are.
SECRET = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_=.-]{20,}$"
LEAD, TRAIL = r"^[\"'(\[{<]+", r"[\"')\]}>.,;:!?]+$"
#: Stand for a neighbouring value, and for the end of the text, within a context.
SLOT, EDGE = "<value>", "<edge>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits x pass Luhn's check."""
    d = F.transform(F.split(F.reverse(x), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(d, F.lit(0), lambda a, v: a + F.coalesce(F.when(v > 9, v - 9).otherwise(v), F.lit(0))) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
    if kind == "card":
        return F.length(digits(x)).between(12, 19) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def running(x: Column) -> Column:
    """Running sums of an array of numbers: within blocks of about the root of its size, then over blocks."""

    def sums(y: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(y, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")))["out"]

    width = F.ceil(F.sqrt(F.size(x))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), lambda b: sums(F.slice(x, b * width + 1, width)))
    last = lambda b: F.element_at(b, -1)
    shifted = once(blocks, lambda bs: F.zip_with(bs, sums(F.transform(bs, last)), lambda b, z: F.transform(b, lambda v: v + z - last(b))))
    return F.when(F.size(x) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<int>"))


def once(x: Column, f) -> Column:
    """f of x, worked out once however often f reads it."""
    return F.transform(F.array(x), f)[0]


def ends(found: Column, pieces: Column) -> Column:
    """Where each match ends, in code points, from the texts between matches and the matches."""
    return once(F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, g: F.length(m) + F.length(g)), running)


def matches(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of all matches in code points."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    spans = once(both, lambda x: F.zip_with(x["m"], ends(x["m"], x["p"]), lambda v, z: F.struct((z - F.length(v)).alias("start"), F.lit(rank).alias("rank"), z.alias("stop"), v.alias("value"))))
    return F.filter(spans, lambda s: keep(s["value"])) if keep else spans


def base_spans(text: Column, kind: str) -> Column:
    hint = F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9]")) if kind == "card" else F.contains(text, F.lit(HINT[kind]))
    found = matches(text, PATTERN[kind], KINDS.index(kind), lambda v: valid(kind, v))
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, OWN)))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def is_seed(value: Column) -> Column:
    """Whether a value is by itself of a base kind, or an unbroken key of letters and digits."""
    whole = {k: F.regexp_like(value, F.lit(f"^(?:{p})$")) & valid(k, value) for k, p in PATTERN.items()}
    return whole["email"] | whole["ip"] | whole["card"] | whole["phone"] | F.regexp_like(value, F.lit(SECRET))


def short(x: Column) -> Column:
    """A key of x: x itself, or a digest where it is long."""
    return F.when(F.length(x) > 64, F.md5(x.cast("binary"))).otherwise(x)


def first_words(t: Column) -> Column:
    """The first two words, lower-cased, with one blank between; fewer if there are fewer."""
    return F.lower(F.regexp_replace(F.regexp_extract(t, HEAD, 1), GAP, " "))


def with_contexts(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """docs with the spans of the values of a text and their lexical patterns: two words before, two words after, one word on either side.

    In steps, each a column of its own, so that nothing is worked out twice.
    """
    values, pieces, before, after, stops = (free_name(docs, f"{name}_{x}") for x in ("values", "pieces", "before", "after", "stops"))
    x = docs.withColumn(values, F.when(F.regexp_like(text, F.lit("[0-9]")), F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))))
    x = x.withColumn(pieces, F.when(F.size(values) > 0, F.split(text, VALUE, -1)))
    mark = lambda at, edge: F.when(at == edge, EDGE).otherwise(SLOT)
    tail = lambda p: F.reverse(first_words(F.reverse(p)))
    x = x.withColumn(before, F.transform(pieces, lambda p, i: F.substring_index(F.trim(F.concat(mark(i, 0), F.lit(" "), tail(p))), " ", -2)))
    x = x.withColumn(after, F.transform(pieces, lambda p, i: F.substring_index(F.trim(F.concat(first_words(p), F.lit(" "), mark(i, F.size(values)))), " ", 2)))
    x = x.withColumn(stops, F.when(F.size(values) > 0, ends(F.col(values), F.col(pieces))))
    around = F.zip_with(F.slice(before, 1, F.size(values)), F.slice(after, 2, F.size(values)), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    placed = F.zip_with(values, stops, lambda v, z: F.struct(v.alias("v"), z.alias("z")))

    def candidate(p: Column, c: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(p["v"], LEAD, ""), TRAIL, "")
        start = p["z"] - F.length(p["v"]) + F.length(F.regexp_extract(p["v"], LEAD, 0))
        one = F.concat_ws(" _ ", F.substring_index(c["b"], " ", -1), F.substring_index(c["a"], " ", 1))
        patterns = F.array(F.concat(c["b"], F.lit(" _")), F.concat(F.lit("_ "), c["a"]), one)
        known = F.filter(patterns, lambda x: ~x.isin(f"{EDGE} _", f"_ {EDGE}", f"{EDGE} _ {EDGE}"))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), F.transform(known, short).alias("patterns"))

    return x.withColumn(name, F.when(F.size(values) > 0, F.zip_with(placed, around, candidate))).drop(values, pieces, before, after, stops)


def bootstrap(found: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """(row, start, stop, value) of unseen identifiers, by iterative scoring of the graph of patterns and instances.

    Instances are distinct values, patterns the words around them. Seeds have confidence 1. In each round
    a pattern's score is the mean confidence of the distinct instances that it extracts; it is trusted
    where `support` of them and the share `least` are known, so a frequent context of other words never is.
    An instance then gets the best score of its trusted patterns. What a trusted pattern of the last round
    extracts is an identifier. The rounds read (pattern, instance) rows only.
    """
    cand = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    graph = cut(cand.select(F.explode("patterns").alias("pattern"), short(F.col("value")).alias("v"), is_seed(F.col("value")).alias("seed")).groupBy("pattern", "v").agg(F.max("seed").alias("seed")))
    known = graph.groupBy("v").agg(F.max("seed").cast("double").alias("s"))
    for k in range(rounds):
        scored = graph.join(known, "v").groupBy("pattern").agg(F.avg("s").alias("p"), F.sum((F.col("s") >= least).cast("long")).alias("f"))
        trusted = cut(scored.where((F.col("p") >= least) & (F.col("f") >= support)).select("pattern", "p"))
        if k + 1 < rounds:
            best = graph.join(trusted, "pattern").groupBy("v").agg(F.max("p").alias("p"))
            known = graph.groupBy("v").agg(F.max("seed").cast("double").alias("own")).join(best, "v", "left").select("v", F.greatest("own", F.coalesce("p", F.lit(0.0))).alias("s"))
    return cand.select("row", "start", "stop", "value", F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi").select("row", "start", "stop", "value").distinct()


def labelled(docs: DataFrame, text_col: str, names: dict[str, str], rounds: int = 3, least: float = 0.8, support: int = 4) -> DataFrame:
    """docs, read once and copied to a table, with their base spans and all spans in columns of the given names."""
    row = free_name(docs, "row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(names["kinds"], F.struct(*(base_spans(text, k).alias(k) for k in KINDS)))
    candidates = free_name(x, "candidates")
    found = cut(with_contexts(x, text, candidates))
    extra = bootstrap(found.select(F.col(row).alias("row"), F.col(candidates).alias("candidates")), rounds, least, support)
    more = free_name(found, "extra")
    extra = cut(extra.groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("stop"), F.col("value"))).cast(SPAN).alias(more)).withColumnRenamed("row", row))
    base = F.concat(*(F.col(f"`{names['kinds']}`.{k}") for k in KINDS))
    apart = F.filter(F.coalesce(F.col(more), F.array().cast(SPAN)), lambda e: ~F.exists(base, lambda b: (b["start"] < e["stop"]) & (b["stop"] > e["start"])))
    return found.drop(candidates).join(extra, row, "left").withColumn(names["spans"], F.concat(base, apart)).drop(row, more)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, joined).

    Spans are in code points, end exclusive. A null text is empty; rows of a repeated or null id are labelled one
    by one; other columns are not carried; an empty table gives no rows.
    """
    out = labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", {"kinds": "kinds", "spans": "spans"}, **options)
    base = F.concat(*(F.col(f"kinds.{k}") for k in KINDS))
    return out.select("doc_id", *(F.size(f"kinds.{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Keeps the columns of docs, whatever their names; n_chars, where there is one, follows the text. Null
    texts stay null, rows of a repeated or null id are redacted one by one, an empty table stays empty.
    """
    kinds = F.array(*map(F.lit, (*KINDS, OWN)))
    names = {"kinds": free_name(docs, "kinds"), "spans": free_name(docs, "spans")}
    found = labelled(docs, "text", names, **options)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        name = F.concat(F.lit("["), F.upper(F.element_at(kinds, s["rank"] + 1)), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, name)).otherwise(acc["out"]).alias("out"))

    spans = F.col(f"`{names['spans']}`")
    end = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    changed = F.size(spans) > 0
    out = found.withColumn("text", F.when(changed, end).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
