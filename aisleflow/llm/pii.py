"""Personal data: fixed patterns, and terms that give away the people behind them, by DataFrame functions alone.

Base spans (e-mail, IP, card, phone) come from Java patterns that match as the plain ones do but never backtrack into a
run, so long unsplit texts neither recurse nor take quadratic time. What they find is protected at three levels: the value
itself, its group (an address' domain, a network, a card's issuer, a number's area) and its kind. Words of two letters or
more and phrases of two words within ``window`` characters of a mention co-occur with its entities. For a term t and an
entity e, n(t, e) counts mentions of e with t near, n(t) all documents with t or mentions near t, whichever are more;
P(e | t) is n(t, e) / n(t), held down to c / (c + 1) of it when t was seen in c different contexts of e, so that copies of
one text prove nothing and two independent ones suffice only where t is hardly seen elsewhere. It says how strongly the
term reveals the entity, and log2(P(e | t) / P(e)) how many bits it discloses, P(e) being the share of documents with e. A
term that discloses ``min_bits`` and reveals e with ``generalise_at`` is generalised to the kind of thing it belongs to
([EMAIL TERM] and so on); from ``remove_at`` on it is removed. Counts cover the whole corpus.

Defined results: a null text counts as empty and has no span; matches that fail their check are dropped, not retried;
overlapping spans are masked as one, under the kind of the first; repeated rows get the same spans each; other columns
pass through, but for those named like an output, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GROUPS = {"email": r"@(.*)$", "ip": r"^([0-9]+\.[0-9]+)\.", "card": r"^((?:[ -]?[0-9]){6})", "phone": r"^(\+[^0-9]*[0-9](?:[^0-9]*[0-9]){3})"}
REMOVED = 8
SPAN = "array<struct<kind:int,start:int,end:int,hit:string>>"


def _guard(kind: str, t: Column) -> Column:
    return {
        "email": t.contains("@"),
        "ip": t.rlike(r"[0-9]\.[0-9]"),
        "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": t.contains("+"),
    }[kind]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(16, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["hit"])


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _placed(kind: int, parts: Column, hits: Column) -> Column:
    """Spans of hits, of which parts are the texts between."""

    # zipped first, as what stands inside a lambda is computed anew for each element; the sums are gathered as text, as
    # appending to a string copies far less than appending to an array of rows
    lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda part, hit: F.struct(F.length(part).alias("skip"), F.length(hit).alias("own")))

    def step(acc, x):
        start = acc["at"] + x["skip"]
        return F.struct((start + x["own"]).alias("at"), F.concat(acc["out"], start.cast("string"), F.lit(",")).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    starts = F.split(F.aggregate(lengths, zero, step, lambda acc: acc["out"]), ",", -1)

    def span(start, hit):
        return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start.cast("int") + F.length(hit)).alias("end"), hit.alias("hit"))

    return F.zip_with(F.slice(starts, F.lit(1), F.size(hits)), hits, span)


def _found(kind: int, pattern: str, t: Column, hits: Column) -> Column:
    return F.when(F.size(hits) > 0, _placed(kind, F.split(t, pattern, -1), hits)).otherwise(F.array().cast(SPAN))


def base_spans(df: DataFrame, text_col: str = "text", out_col: str = "base") -> DataFrame:
    """df with ``out_col``: valid spans by kind, then start (code points, end exclusive)."""
    df = df.drop(out_col) if out_col in df.columns else df
    t = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__hits_{k}": F.when(_guard(k, t), F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    spans = [F.filter(_found(n, PATTERNS[k], t, F.col(f"__hits_{k}")), _check(k)) for n, k in enumerate(KINDS)]
    return df.withColumn(out_col, F.concat(*spans)).drop(*[f"__hits_{k}" for k in KINDS])


def _terms(*parts: Column) -> Column:
    """The distinct words of two letters or more, and the phrases of two words that follow each other in a part."""
    out = []
    for part in parts:
        w = F.regexp_extract_all(F.lower(part), F.lit(r"\p{L}+"), F.lit(0))
        n = F.greatest(F.size(w) - 1, F.lit(0))
        out += [F.filter(w, lambda x: F.length(x) > 1), F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))]
    return F.array_distinct(F.concat(*out))


def _entities(kind: Column, hit: Column) -> Column:
    """What a mention is of: (level, kind, entity) for its value, its group and its kind."""
    group = F.lit("")
    for n, k in enumerate(KINDS):
        group = F.when(kind == n, F.regexp_extract(hit, GROUPS[k], 1)).otherwise(group)
    rows = [F.struct(F.lit(level).alias("level"), kind.alias("kind"), e.alias("entity")) for level, e in ((0, hit), (1, group), (2, F.lit("")))]
    return F.array(*rows)


def disclosures(based: DataFrame, text_col: str = "text", base_col: str = "base", window: int = 80, generalise_at: float = 0.5, remove_at: float = 0.8, min_bits: float = 4.0) -> DataFrame:
    """(term, level, kind, entity, contexts, p, bits, action) of the terms that reveal an entity beyond the thresholds, one
    row for each term: that of the most bits."""
    t = F.col(text_col)
    # exploded without a filter before, which Spark would push below and so compute every span twice
    mention = based.select(t.alias("text"), F.xxhash64(t, F.lit(3)).alias("doc"), F.explode(base_col).alias("s"))
    before = F.substring(F.col("text"), F.greatest(F.col("s.start") - window, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(window)))
    before = F.when(F.col("s.start") > window, F.regexp_replace(before, r"^\p{L}*+", "")).otherwise(before)
    after = F.regexp_replace(F.substring(F.col("text"), F.col("s.end") + 1, F.lit(window + 1)), r"\p{L}++$", "")
    near = materialise(mention.select(F.col("s.kind").alias("kind"), F.lower("s.hit").alias("hit"), before.alias("before"), after.alias("after"), "doc"), "pii-mentions")
    context = F.xxhash64("before", "after")
    # one row for each term of each context: how often that context stands there, copies and all
    each = near.groupBy("kind", "hit", "before", "after").agg(F.count("*").alias("n")).select("kind", "hit", "n", context.alias("context"), F.explode(_terms(F.col("before"), F.col("after"))).alias("term"))
    # a term that stands near many entities reveals none of them: that is known from the mentions alone, before any text is read
    around = each.groupBy("term").agg(F.sum("n").alias("n_near"), F.count_distinct("context").alias("c_near")).where("c_near > 1").drop("c_near")
    levelled = each.join(around, "term").select("term", "n_near", "n", "context", F.explode(_entities(F.col("kind"), F.col("hit"))).alias("e")).select("term", "n_near", "n", "context", "e.*")
    # by context first, so that a term's or a kind's many mentions are summed before they meet
    levelled = levelled.groupBy("term", "n_near", "level", "kind", "entity", "context").agg(F.sum("n").alias("n"))
    candidates = levelled.groupBy("term", "n_near", "level", "kind", "entity").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_te"))
    sure = F.col("contexts") / (F.col("contexts") + 1)
    candidates = materialise(candidates.where((F.col("contexts") > 1) & (F.col("n_te") / F.col("n_near") * sure >= generalise_at)), "pii-candidates")
    sizes = near.select("doc", F.explode(_entities(F.col("kind"), F.col("hit"))).alias("e")).groupBy("e", "doc").agg(F.count("*").alias("n")).groupBy("e").agg(F.count("*").alias("texts"), F.sum("n").alias("n_e")).select("e.*", "n_e")
    wanted = candidates.select("term").distinct()
    words = based.select(F.explode(_terms(F.coalesce(t, F.lit("")))).alias("term"))
    frequency = words.join(_small(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    total = based.count()
    p = F.col("n_te") / F.greatest("n_t", "n_near") * sure
    scored = candidates.join(frequency, "term").join(sizes, ["level", "kind", "entity"]).select("term", "level", "kind", "entity", "contexts", p.alias("p"), F.log2(p * F.lit(float(max(total, 1))) / F.least(F.col("n_e"), F.lit(max(total, 1)))).alias("bits"))
    scored = scored.where((F.col("p") >= generalise_at) & (F.col("bits") >= min_bits))
    best = scored.groupBy("term").agg(F.max(F.struct("bits", "p", "contexts", "level", "kind", "entity")).alias("b")).select("term", "b.*")
    return materialise(best.withColumn("action", F.when(F.col("p") >= remove_at, "remove").otherwise("generalise")), "pii-disclosures")


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be sent to all executors where it has few rows; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def find(df: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """df with base (spans of the patterns) and extra (spans of revealing terms: kind 4 to 7 generalised to the kind of what
    they reveal, REMOVED removed)."""
    df = df.drop(*[c for c in ("base", "extra") if c in df.columns])
    based = base_spans(df, text_col)
    known = disclosures(based, text_col, **thresholds)
    none = F.array().cast(SPAN)
    if known.isEmpty():
        return based.withColumn("extra", none)
    t = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"__a": F.xxhash64(t), "__b": F.xxhash64(F.lit(7), t)}
    # a text that holds a revealing term is looked at once, whatever its copies; the rest don't leave their place
    words = df.select(t.alias("text"), F.explode(_terms(t)).alias("term")).join(_small(known.select("term", "kind", "action")), "term")
    kind = F.when(F.col("action") == "remove", REMOVED).otherwise(F.col("kind") + len(KINDS))
    matched = words.select("text", "term", kind.alias("_kind")).distinct()
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.regexp_replace("term", " ", r"[^\\p{L}]+"), F.lit(r"(?!\p{L})"))
    marked = matched.withColumn("_pattern", pattern).withColumn("_hits", F.regexp_extract_all(F.col("text"), F.col("_pattern"), F.lit(0)))
    spans = F.transform(_placed(4, F.split(F.col("text"), F.col("_pattern"), -1), F.col("_hits")), lambda s: s.withField("kind", F.col("_kind")))
    marked = marked.select(F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(7), F.col("text")).alias("__b"), spans.alias("spans"))
    marked = materialise(marked.groupBy("__a", "__b").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("extra")), "pii-matches")
    few = marked.agg(F.coalesce(F.sum(F.size("extra")), F.lit(0))).first()[0] <= 200_000
    out = based.withColumns(keys).join(F.broadcast(marked) if few else marked, ["__a", "__b"], "left").drop("__a", "__b")
    return out.withColumn("extra", F.coalesce(F.col("extra"), none))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by kind and then start."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.least(s["kind"], F.lit(4)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with [EMAIL], [IP], [CARD], [PHONE], or [EMAIL TERM] and so on, for its spans; removed terms leave nothing."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], *[F.lit(f"[{k.upper()} TERM]") for k in KINDS], F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.element_at(labels, s["kind"] + 1)).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(df: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """df with the text's spans masked; all other columns stay as they are, whatever their names."""
    packed = df.select(F.struct(*df.columns).alias("__row"), F.col(text_col).alias("__text"))
    found = find(packed, "__text", **thresholds).withColumn("__text", masked(F.col("__text"), F.concat("base", "extra")))
    return found.select(*[(F.col("__text") if c == text_col else F.col("__row")[c]).alias(c) for c in df.columns])
