"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query of the trigrams that every match must hold is derived. The
index has, for each shard of documents and each trigram of those queries, the list of documents
with it; intersecting and uniting these lists gives a rule's candidates, and only candidates are
verified with the regex. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import by_ids, materialize, unused

SHARD_ROWS = 2_000  #: documents of a shard of the index, about


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` must mean the same to Java and to Python; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE_RULES = [
    SecretRule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
]
MORE_RULES = [
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
]

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
_MOST = 64  #: exact strings followed at once while a pattern is read


def trigram_query(pattern: str) -> Query:
    """The condition on a lower-cased text's trigrams that every match of ``pattern`` implies."""
    exact, query = _read(re._parser.parse(pattern))
    return _and(query, _strings(exact))


def _and(*qs: Query) -> Query:
    flat = {x for q in qs if q is not True for x in (q[1] if q[0] == "and" else (q,))}
    if not flat:
        return True
    return flat.pop() if len(flat) == 1 else ("and", tuple(sorted(flat, key=str)))


def _or(*qs: Query) -> Query:
    if not qs or any(q is True for q in qs):
        return True
    flat = {x for q in qs for x in (q[1] if q[0] == "or" else (q,))}
    needs = {q: frozenset(q[1]) if q[0] == "and" else frozenset([q]) for q in flat}
    flat = {q for q in flat if not any(needs[o] < needs[q] for o in flat)}  # a or (a and b) is a
    return flat.pop() if len(flat) == 1 else ("or", tuple(sorted(flat, key=str)))


def _strings(exact: set[str] | None) -> Query:
    """One of these strings occurs."""
    if exact is None:
        return True
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in exact))


def _read(items) -> tuple[set[str] | None, Query]:
    """The strings that the end of ``items`` may be (None: anything), and the trigrams that go before."""
    from re import _constants as k

    exact: set[str] | None = {""}
    query: Query = True
    for op, arg in items:
        if op is k.LITERAL:
            some, inner = {chr(arg).lower()}, True
        elif op is k.IN and all(o is k.LITERAL or o is k.RANGE for o, _ in arg):
            some = {chr(c).lower() for o, a in arg for c in ([a] if o is k.LITERAL else range(a[0], a[1] + 1))}
            some, inner = (some if len(some) <= 8 else None), True
        elif op is k.SUBPATTERN:
            some, inner = _read(arg[3])
        elif op is k.BRANCH:
            parts = [_read(x) for x in arg[1]]
            if all(p[0] is not None and p[1] is True for p in parts):
                some, inner = set().union(*(p[0] for p in parts)), True
            else:
                some, inner = None, _or(*(_and(q, _strings(e)) for e, q in parts))
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            low, high, body = arg
            e, q = _read(body)
            if (low, high) == (0, 1) and e is not None and q is True:
                some, inner = e | {""}, True
            elif low == high and e is not None and q is True and len(e) ** low <= _MOST:
                some, inner = reduce(lambda a, b: {x + y for x in a for y in b}, [e] * low, {""}), True
            else:
                some, inner = None, (_and(q, _strings(e)) if low else True)
        else:  # anchors, any character, classes: no text of their own that is known
            some, inner = None, True
        if some is None or exact is None or len(exact) * len(some) > _MOST:
            query, exact = _and(query, _strings(exact), inner), some if some is not None and exact is None else None if some is None else some
        else:
            exact, query = {x + y for x in exact for y in some}, _and(query, inner)
    return exact, query


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def build_index(docs: DataFrame, trigrams: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(shard, trigram, ids)``: documents of each shard whose lower-cased text has the trigram.

    Shards are by a hash of doc_id, so a trigram that is everywhere is spread over all of them and
    no list is longer than its shard. Rows without doc_id aren't in it: they are always candidates.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    has = F.filter(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    found = docs.where("doc_id is not null").select("doc_id", low.alias("_low")).select("doc_id", F.explode(has).alias("trigram"))
    return found.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def candidates(index: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """``(doc_id, kinds)``: the rules whose trigram query a document meets."""
    none = F.array().cast("array<bigint>")

    def listed(q: Query) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.element_at("postings", q), none)
        parts = F.array(*(listed(x) for x in q[1]))
        join = F.array_intersect if q[0] == "and" else F.array_union
        return F.aggregate(F.slice(parts, 2, len(q[1]) - 1), F.get(parts, F.lit(0)), lambda a, b: join(a, b))

    shards = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))
    per_rule = F.array(*(F.struct(F.lit(r.kind).alias("kind"), listed(trigram_query(r.pattern)).alias("ids")) for r in rules))
    found = shards.select(F.explode(per_rule).alias("r")).select("r.kind", F.explode("r.ids").alias("doc_id"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _running(values: Column, add) -> Column:
    """``values`` (an array that isn't empty) combined from the first on, by doubling steps, so that long arrays take n log n."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(a: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= back, add(x, F.coalesce(F.get(a, i - back), x))).otherwise(x))

    return F.aggregate(steps, values, step)


def _named_once(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole(rule: SecretRule) -> str:
    """The rule's pattern with its least length inside, where that finds the same matches: runs of a class, whose head is of that class too."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        at = rule.pattern.rindex("[")
        head = rule.pattern[:at]
        if (head == "" or head.isalnum()) and re.fullmatch(rule.pattern[at:], head or "a") is not None:
            return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(head))},}}"
    return rule.pattern


def _spans(rule: SecretRule, text: Column) -> Column:
    """``array<struct<start,end>>`` of a rule's matches, from the lengths of the matches and of the text between them."""
    pattern = _whole(rule)
    hits, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
    long = F.transform(hits, F.char_length)
    worth = long if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), F.char_length)
    cut = F.struct(long.alias("hits"), F.transform(between, F.char_length).alias("between"), worth.alias("worth"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def spans(c: Column) -> Column:
        steps = F.transform(c["hits"], lambda n, i: n + F.coalesce(F.get(c["between"], i), F.lit(0)))
        ends = _running(steps, lambda x, y: x + y)
        each = F.zip_with(ends, c["hits"], lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
        kept = F.filter(each, lambda s, i: F.get(c["worth"], i) >= rule.least)
        return F.when(F.size(c["hits"]) > 0, kept).otherwise(none)

    return _named_once(cut, spans)


def scan(docs: DataFrame, rules: list[SecretRule] | None = None, shard_rows: int = SHARD_ROWS, out: str = "found") -> DataFrame:
    """``docs`` with column ``out``: ``array<struct<kind, start, end>>`` of each row's matches, by start, then in the order of ``rules``.

    Positions are code points, ends exclusive; per rule matches are leftmost and don't overlap. A
    null text is empty and has none. Rows with equal or null doc_id are each judged by their own
    text. A column of the name ``out`` is replaced, all others pass through; an empty table stays
    empty. Time and memory follow a text's length and its number of matches, times a logarithm.
    """
    rules = [*BASE_RULES, *MORE_RULES] if rules is None else rules
    docs = docs.drop(out)
    (kinds,) = unused(docs, "kinds_")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind] is not True]
    if indexed:
        vocabulary = sorted(set().union(*(trigrams_of(queries[r.kind]) for r in indexed)))
        index = materialize(build_index(docs.select("doc_id", "text"), vocabulary, shard_rows), "secrets-index")
        df = by_ids(docs, materialize(candidates(index, indexed).withColumnRenamed("kinds", kinds), "secrets-candidates"), "doc_id", "left")
    else:
        df = docs.withColumn(kinds, F.lit(None).cast("array<string>"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = []
    for rank, rule in enumerate(rules):
        # a cheap test first: most texts that are scanned fully have no match that is long enough
        quick = text.rlike(_whole(rule))
        due = quick if queries[rule.kind] is True else (F.array_contains(kinds, rule.kind) | F.col("doc_id").isNull()) & quick
        spans = F.transform(_spans(rule, text), _named(rule.kind, rank))
        found.append(F.when(due, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    ordered = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn(out, ordered).select(*(F.col(f"`{c}`") for c in docs.columns), F.col(out))


def _named(kind: str, rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base rules' spans, and all spans of each row of ``docs(doc_id, text, ...)``.

    A row per row, repeated rows too; a null or empty text has zero counts, the digest of "" and no
    spans. Other columns are ignored; an empty table gives no rows.
    """
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


PART = 1024  #: code points of the parts that a text is cut from


def redact(docs: DataFrame, rules: list[SecretRule] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping matches replaced by ``mark``, and ``n_chars``, if there is one, counted anew.

    Rows without a match keep text and n_chars as they are, nulls too. All other columns pass
    through, whatever their names; repeated rows are changed alike; an empty table stays empty.
    """
    found, text = unused(docs, "found_"), F.col("text").cast("string")
    found, scanned = found[0], scan(docs, rules, out=found[0])
    # parts in order, so that a piece is cut without walking through the text from its beginning
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), 0).alias("parts"), F.col(found).alias("spans"), _running(F.col(found)["end"], F.greatest).alias("upto"))

    def clean(c: Column) -> Column:
        def piece(start: Column, stop: Column) -> Column:
            first, last = F.floor(start / PART).cast("int"), F.floor((stop - 1) / PART).cast("int")
            near = F.array_join(F.slice(c["parts"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return F.when(stop > start, F.substring(near, start - first * PART + 1, stop - start)).otherwise("")

        # a span that begins before an earlier one ends belongs to that one's run
        before = lambda i: F.coalesce(F.get(c["upto"], i - 1), F.lit(0))
        marked = F.transform(c["spans"], lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.concat(piece(before(i), s["start"]), F.lit(mark))).otherwise(""))
        rest = piece(F.element_at(c["upto"], -1), F.char_length(text))
        return F.concat(F.array_join(marked, ""), rest)

    some = F.size(found) > 0
    out = scanned.withColumn("text", F.when(some, _named_once(cut, clean)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
