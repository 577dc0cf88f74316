"""Personal data: plain patterns, and contextual extraction bootstrapped from them.

Four patterns give the base spans. They seed a bootstrap: the words around the
seeds are lexical patterns (the two words before, or the word before and the
word after), identifier-like tokens in such contexts are instances, and the
graph of patterns and instances is scored in rounds. A pattern scores the mean
of its instances' scores with one failure added, an instance the best of its
patterns', seeds always 1. Tokens in contexts whose final score is high and
that enough different seeds support are reported as kind ``context``.

All of it is DataFrame expressions. Texts are read once; what goes on from
there are spans and short contexts. Patterns are possessive or anchored at the
end of the match before, so that no text makes them backtrack at length.

Defined cases: a null or empty text has no spans; a text of any length is read
whole, and so are the words of a context; repeated rows give repeated results;
rows with one id and different texts are told apart by a hash of the text; of
base spans that cover one token the first by kind and start counts; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.llm.durable import checkpointed, written

KINDS = ("email", "ip", "card", "phone")

#: A run starts at a character that no run holds already, or where the match before ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like tokens: runs without white space that hold a digit.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_GAP = r"[\x20\x09-\x0D]+"

_SPAN = "array<struct<s:int,e:int,hit:string>>"
_SPACES = " \t\n\x0b\x0c\r"
#: Pairs of tokens and base spans of a text that are looked at one by one.
COMPARED = 20_000
#: Matches whose starts are added up in one go, so that long texts copy no long arrays.
_STRIDE = 128


def _parts(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """The text between matches, and the matches; null where ``when`` says that there are none.

    They must become columns before :func:`_spans` takes them, or each step would match again.
    """
    return F.when(when, F.split(text, pattern, -1)), F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _spans(gaps: Column, hits: Column) -> Column:
    """All matches as (start, end, match), a stride of them at a time."""
    n, none = F.size(hits), F.array().cast(_SPAN)

    def step(done, k):
        s = done["at"] + F.length(F.get(gaps, k))
        hit = F.get(hits, k)
        return F.struct((s + F.length(hit)).alias("at"), F.concat(done["found"], F.array(F.struct(s.alias("s"), (s + F.length(hit)).alias("e"), hit.alias("hit")))).alias("found"))

    def stride(done, c):
        start = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("found"))
        return F.concat(done, F.array(F.aggregate(F.sequence(c * _STRIDE, F.least(n, (c + 1) * _STRIDE) - 1), start, step)))

    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("found")))
    strides = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / _STRIDE).cast("int")), first, stride)
    return F.when(n > 0, F.flatten(F.transform(strides, lambda x: x["found"]))).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(total, k):
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros aside, more than three digits are over 255
        part = lambda p: F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(part(p)) <= 4, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(16, 19), _luhn(_digits(hit))).otherwise(False)
    return F.length(_digits(hit)).between(8, 15)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["hit"])


#: Each kind's pattern, and a cheap test that a text with a match passes.
_FINDERS = {"email": (_EMAIL, "@"), "ip": (_IP, "."), "card": (_CARD, ""), "phone": (_PHONE, "+")}


def _tokens(gaps: Column, hits: Column) -> Column:
    """Identifier-like tokens as (start, end, trimmed token, the two words before, the word before and the word after)."""
    spans = _spans(gaps, hits)

    def words_before(gap, k):
        # where the gap is short, what stands before it is another token or the text's start
        edge = F.when(k == 0, F.lit("^")).otherwise(F.lit("#"))
        near = F.split(F.reverse(F.lower(F.btrim(gap, F.lit(_SPACES)))), _GAP, 3)
        word = lambda i: F.coalesce(F.nullif(F.reverse(F.get(near, F.lit(i))), F.lit("")), edge)
        return F.array(word(1), word(0))

    def word_after(gap):
        return F.coalesce(F.nullif(F.get(F.split(F.lower(F.btrim(gap, F.lit(_SPACES))), _GAP, 2), F.lit(0)), F.lit("")), F.lit("$"))

    def one(span, k):
        before, after = words_before(F.get(gaps, k), k), word_after(F.get(gaps, k + 1))
        left = F.regexp_replace(span["hit"], r"^[^0-9\p{L}+]+", "")
        core = F.regexp_replace(left, r"[^0-9\p{L}]+$", "")
        s = span["s"] + F.length(span["hit"]) - F.length(left)
        return F.struct(
            s.alias("s"), (s + F.length(core)).alias("e"), F.lower(core).alias("token"),
            F.array(F.concat(F.lit("before "), F.array_join(before, " ")), F.concat(F.lit("around "), F.get(before, F.lit(1)), F.lit(" _ "), after)).alias("patterns"),
        )

    return F.transform(spans, one)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["hit"].alias("hit")))


def trusted_patterns(edges: DataFrame, rounds: int, min_seeds: int, threshold: float) -> DataFrame:
    """Patterns (column pattern) whose score ends at ``threshold`` or more.

    ``edges`` has distinct (pattern, instance, seed). A pattern needs ``min_seeds`` different seeds, from the first round on.
    """
    seeds = edges.where("seed").groupBy("pattern").count().where(F.col("count") >= min_seeds).select("pattern")
    edges = checkpointed(edges.join(seeds, "pattern", "left_semi"))
    scored = edges.select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"))
        if k + 1 == rounds:
            break
        best = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("trust").alias("trust"))
        scored = checkpointed(edges.join(best, "instance").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("trust")).alias("score")))
    return patterns.where(F.col("trust") >= threshold).select("pattern")


_TEXT = ("doc_id", "h", "n")


def _covered(read: DataFrame) -> DataFrame:
    """(doc_id, h, n, x, b): each identifier-like token with the first base span, by kind and start, that shares a place with it.

    Texts with few of both are matched row by row. In the others tokens and spans become rows and are merged by place: of a
    kind, whose spans do not overlap, only the last that begins before a token and the next one can share a place with it.
    """
    read = read.where(F.size("tokens") > 0)
    few = F.size("base").cast("long") * F.size("tokens") <= COMPARED
    near = F.get(F.filter("base", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"])), F.lit(0))
    small = read.where(few).select(*_TEXT, "base", F.explode("tokens").alias("x")).where("x.e > x.s").select(*_TEXT, "x", near.alias("b"))
    tokens = read.where(~few).select(*_TEXT, F.explode("tokens").alias("x")).where("x.e > x.s").select(*_TEXT, F.col("x.s").alias("at"), "x")
    spans = read.where(~few).select(*_TEXT, F.explode("base").alias("b")).select(*_TEXT, F.col("b.s").alias("at"), "b")
    rows = spans.unionByName(tokens, allowMissingColumns=True)
    token = F.col("x").isNotNull()
    before = Window.partitionBy(*_TEXT).orderBy("at", token).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*_TEXT).orderBy(F.desc("at"), token.desc()).rowsBetween(Window.unboundedPreceding, 0)
    for k in KINDS:
        own = F.when(F.col("b.kind") == k, F.col("b"))
        rows = rows.withColumns({f"p_{k}": F.last(own, True).over(before), f"n_{k}": F.last(own, True).over(after)})
    shares = [F.when(F.col(f"p_{k}.e") > F.col("x.s"), F.col(f"p_{k}")).when(F.col(f"n_{k}.s") < F.col("x.e"), F.col(f"n_{k}")) for k in KINDS]
    return small.unionByName(rows.where(token).select(*_TEXT, "x", F.coalesce(*shares).alias("b")))


def find(docs: DataFrame, rounds: int = 3, min_seeds: int = 5, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind, a digest of the base spans, all spans as kind:start:end, and n_context.

    Offsets are code points, ends exclusive; spans come by kind as listed, context last, then start.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"))
    finders = {k: _parts(F.col("t"), p, F.contains(F.col("t"), F.lit(needs))) for k, (p, needs) in _FINDERS.items()} | {"tokens": _parts(F.col("t"), _TOKEN, F.col("t").rlike("[0-9]"))}
    read = read.select("doc_id", F.xxhash64("t").alias("h"), F.length("t").alias("n"), *[c.alias(f"{k}_{part}") for k, both in finders.items() for part, c in zip(("gaps", "hits"), both, strict=True)])
    spans = {k: F.filter(_spans(F.col(f"{k}_gaps"), F.col(f"{k}_hits")), _keeps(k)) for k in KINDS}
    read = read.select("doc_id", "h", "n", *[c.alias(k) for k, c in spans.items()], _tokens(F.col("tokens_gaps"), F.col("tokens_hits")).alias("tokens"))
    base = F.concat(*[_named(F.col(k), k) for k in KINDS])
    read = written(read.select("doc_id", "h", "n", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), "tokens"))

    # a token that a base span begins in stands for the whole span; tokens further on in it stand for nothing
    at = _covered(read).where("b is null or x.s <= b.s")
    at = at.select("doc_id", "h", "n", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.coalesce(F.lower("b.hit"), "x.token").alias("instance"), F.col("b").isNotNull().alias("seed"), F.explode("x.patterns").alias("pattern"))
    edges = at.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    trusted = checkpointed(trusted_patterns(edges, rounds, min_seeds, threshold))
    more = at.where("not seed").join(trusted, "pattern", "left_semi").groupBy("doc_id", "h", "n").agg(F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), "s", "e"))).alias("context"))
    own = more.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("n").alias("_n"), "context")
    out = read.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left")
    context = F.coalesce("context", F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.concat(plain, context)).alias("spans"), F.size(context).cast("long").alias("n_context"))
