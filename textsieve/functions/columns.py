"""Column functions of approximate text search.

Predicates with a constant pattern are a native prefilter, where one can be had, and the matcher,
run on Arrow batches; without edits a pattern that Java's regular expressions read alike stays in
the JVM.  Patterns may also be columns; those are compiled once for each distinct value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsieve.functions import nfa, trigrams
from textsieve.functions import regex as rx
from textsieve.functions.pattern import SCHEMA, Pattern, of
from textsieve.plans import prefilter
from textsieve.settings import setting
from textsieve.shipping import ensure

VERSION = "textsieve 1.0.0"
DETAIL = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cost", "num_ins", "num_del", "num_subst", "match_start", "match_end")])


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ready() -> None:
    if spark := SparkSession.getActiveSession():
        ensure(spark)


def _check(pattern: str, k: int, max_states: int | None = None) -> nfa.Matcher:
    if k < 0:
        raise ValueError("the maximal cost may not be negative")
    return nfa.compiled(pattern, max_states or setting("max_states"))


def java_regex(node: rx.Node) -> str | None:
    """The pattern for Java, if it means the same there."""
    match node:
        case rx.Empty():
            return ""
        case rx.Chars(kind="any"):
            return "[\\s\\S]"
        case rx.Chars():
            # an escape for each bound, so no character has a meaning of its own
            body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in node.ranges)
            return None if len(node.ranges) > 50 else f"[{'^' * node.negated}{body}]" if node.kind == "class" else body
        case rx.Anchor():
            return "\\z" if node.end else "\\A"
        case rx.Concat() | rx.Alt():
            a, b = java_regex(node.left), java_regex(node.right)
            return None if a is None or b is None else a + b if isinstance(node, rx.Concat) else f"(?:{a}|{b})"
        case rx.Repeat():
            a = java_regex(node.item)
            return None if a is None else f"(?:{a}){{{node.least},{'' if node.most is None else node.most}}}"
    return None


def _weighted_hint(text: Column, pattern: str, k: int, weights: tuple[int, int, int]) -> Column:
    """text, or null where no match of such costs can be."""
    if min(weights) < 0:
        raise ValueError("costs may not be negative")
    # edits number k / least cost at most, and k by the clamp on counts
    least = min(weights)
    hint = prefilter.column(prefilter.formula(pattern, min(k, k // least) if least else k), text)
    return text if hint is None else F.when(hint, text)


def _costs(text: Column, pattern: str, k: int, max_states: int, pieces: list[str] | None = None, weights: tuple[int, int, int] = (1, 1, 1)) -> Column:
    _ready()

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.to_list()
        # equal texts are matched once
        distinct = list(dict.fromkeys(t for t in known if t is not None))
        found = dict(zip(distinct, nfa.compiled(pattern, max_states).costs(distinct, k, pieces, weights)))
        return pd.Series([found.get(t) for t in known], dtype="Int32")

    return run(text)


def amatch_cost(text: Column | str, pattern: Column | str | Pattern, k: int = 0, max_states: int | None = None) -> Column:
    """The least number of edits, at most k, that makes a part of text match; null without a match or for null.

    pattern: a constant, or a column of patterns.
    """
    text, max_states = _col(text), max_states or setting("max_states")
    if isinstance(pattern, Column):
        _ready()

        @F.pandas_udf("int")
        def each(texts: pd.Series, patterns: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(texts), dtype="Int32")
            for p, rows in texts.groupby(patterns).groups.items():
                out.loc[rows] = pd.array(nfa.compiled(p, max_states).costs(texts.loc[rows].to_list(), k), "Int32")
            return out

        return each(text, pattern)
    pattern = pattern.pattern if isinstance(pattern, Pattern) else pattern
    matcher = _check(pattern, k, max_states)
    java = java_regex(matcher.tree) if k == 0 else None
    if java is not None:
        return F.when(text.rlike(java), F.lit(0))
    formula = prefilter.formula(pattern, k)
    hint = prefilter.column(formula, text)
    # a text that the prefilter rejects reaches the matcher as null, and costs nothing there
    return _costs(text if hint is None else F.when(hint, text), pattern, k, max_states, prefilter.pieces(formula))


def amatch(text: Column | str, pattern: Column | str | Pattern, k: int = 0, cost_ins: int = 1, cost_del: int = 1, cost_subst: int = 1) -> Column:
    """Whether a part of text matches within k edits, or edits of total cost k; null for null."""
    text = _col(text)
    if (cost_ins, cost_del, cost_subst) != (1, 1, 1):
        if isinstance(pattern, Column) or setting("match_timeout_ms"):
            return F.when(text.isNotNull(), amatch_detail(text, pattern, k, cost_ins, cost_del, cost_subst).isNotNull())
        p, weights = pattern.pattern if isinstance(pattern, Pattern) else pattern, (cost_ins, cost_del, cost_subst)
        _check(p, k)
        return F.when(text.isNotNull(), _costs(_weighted_hint(text, p, k, weights), p, k, setting("max_states"), weights=weights).isNotNull())
    known = text.isNotNull() & pattern.isNotNull() if isinstance(pattern, Column) else text.isNotNull()
    if not isinstance(pattern, Column):
        p = pattern.pattern if isinstance(pattern, Pattern) else pattern
        matcher = _check(p, k)
        java = java_regex(matcher.tree) if k == 0 else None
        if java is not None:
            plain = rx.literal(matcher.tree)
            return text.contains(plain) if plain is not None else _narrowed(text, prefilter.formula(p, 0), text.rlike(java))
    return F.when(known, amatch_cost(text, pattern, k).isNotNull())


def amatch_detail(text: Column | str, pattern: str | Pattern | Column, k: int = 0, cost_ins: int = 1, cost_del: int = 1, cost_subst: int = 1, timeout: float | None = None) -> Column:
    """cost, num_ins, num_del, num_subst, match_start, match_end (byte offsets) of the best match, or null.

    timeout: seconds that a text may take at most, by default what the session's match_timeout_ms says;
    more is an error.
    """
    text = _col(text)
    timeout = (setting("match_timeout_ms") / 1000 or None) if timeout is None else timeout
    _ready()

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame([r or (None,) * 6 for r in rows], columns=DETAIL.names).astype("Int32")

    def one(p: str, texts: list) -> list:
        return nfa.compiled(p).details(texts, k, cost_ins, cost_del, cost_subst, timeout)

    if isinstance(pattern, Column):

        @F.pandas_udf(DETAIL)
        def each(texts: pd.Series, patterns: pd.Series) -> pd.DataFrame:
            rows: list = [None] * len(texts)
            for p, mine in texts.reset_index(drop=True).groupby(patterns.to_numpy()).groups.items():
                for i, r in zip(mine, one(p, texts.iloc[mine].to_list())):
                    rows[i] = r
            return frame(rows)

        found = each(text, pattern)
        return F.when(found["cost"].isNotNull(), found)
    pattern = pattern.pattern if isinstance(pattern, Pattern) else pattern
    _check(pattern, k)
    hinted = _weighted_hint(text, pattern, k, (cost_ins, cost_del, cost_subst))

    @F.pandas_udf(DETAIL)
    def search(texts: pd.Series) -> pd.DataFrame:
        return frame(one(pattern, texts.to_list()))

    found = search(hinted)
    return F.when(found["cost"].isNotNull(), found)


def match(text: Column | str, pattern: str | Pattern) -> Column:
    """amatch by a pattern in text form; its own costs are kept, but edits count 1 each."""
    p = of(pattern)
    return amatch(text, p.pattern, p.max_cost)


def distance(text: Column | str, pattern: str | Pattern, k: int | None = None) -> Column:
    """amatch_cost by a pattern and k, or by a pattern in text form."""
    p = of(pattern) if k is None else Pattern(pattern, k)
    return amatch_cost(text, p.pattern, p.max_cost)


def similarity(text: Column | str, pattern: str | Pattern, k: int | None = None) -> Column:
    """0 without a match, else 1 less cost as a share of the longer of text and pattern, in bytes."""
    text = _col(text)
    p = of(pattern) if k is None else Pattern(pattern, k)
    cost = amatch_cost(text, p.pattern, p.max_cost)
    longest = F.greatest(F.octet_length(text), F.lit(len(p.pattern.encode())))
    return F.when(text.isNotNull(), F.when(cost.isNull(), 0.0).when(longest == 0, 1.0).otherwise(1.0 - cost / longest))


def _narrowed(text: Column, formula, exact: Column) -> Column:
    """The exact predicate behind plain searches for what a match must have, which are faster and reach the scan."""
    hint = prefilter.column(formula, text)
    return exact if hint is None else hint & exact


def like_parts(pattern: str) -> list[str]:
    """The texts of a LIKE pattern between its wildcards."""
    parts, run, at = [], "", 0
    while at < len(pattern):
        x = pattern[at]
        if x == "\\" and at + 1 < len(pattern):
            at += 1
            run += pattern[at]
        elif x in "%_":
            parts.append(run)
            run = ""
        else:
            run += x
        at += 1
    return [p for p in [*parts, run] if p]


def like(text: Column | str, pattern: str) -> Column:
    text, parts = _col(text), like_parts(pattern)
    if pattern.strip("%") == "".join(parts) and len(parts) <= 1:  # Spark has it as a plain search already
        return text.like(pattern)
    return _narrowed(text, ("all", [("has", p) for p in parts]) if parts else None, text.like(pattern))


def ilike(text: Column | str, pattern: str) -> Column:
    return _col(text).ilike(pattern)


def regex_match(text: Column | str, pattern: str, fold: bool = False) -> Column:
    """Exact POSIX match; fold: case doesn't matter."""
    tree = rx.parse(pattern)
    java = java_regex(tree)
    if java is None:
        if fold:
            raise rx.RegexError("this pattern can't be matched without regard to case")
        return amatch(text, pattern, 0)
    exact = _col(text).rlike(("(?iu)" if fold else "") + java)
    return exact if fold else _narrowed(_col(text), prefilter.formula(pattern, 0), exact)


def _extent(strict: bool):
    @F.pandas_udf("float")
    def run(words: pd.Series, texts: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for w, t in zip(words, texts):
            if w is None or t is None:
                out.append(None)
                continue
            if (w, t) not in seen:
                if len(seen) > 10_000:
                    seen.clear()
                seen[w, t] = float(trigrams.extent_similarity(w, t, strict))
            out.append(seen[w, t])
        return pd.Series(out, dtype="Float32")

    return run


def word_similarity(word: Column, text: Column) -> Column:
    """The greatest similarity of word to an extent of text."""
    _ready()
    return _extent(False)(word, text)


def strict_word_similarity(word: Column, text: Column) -> Column:
    """The same, of extents of whole words."""
    _ready()
    return _extent(True)(word, text)


def word_sim_op(word: Column, text: Column, threshold: float | None = None) -> Column:
    return word_similarity(word, text).cast("double") >= F.lit(float(setting("word_similarity_threshold") if threshold is None else threshold))


def strict_word_sim_op(word: Column, text: Column, threshold: float | None = None) -> Column:
    return strict_word_similarity(word, text).cast("double") >= F.lit(float(setting("strict_word_similarity_threshold") if threshold is None else threshold))


def word_distance(word: Column, text: Column) -> Column:
    return (F.lit(1.0).cast("float") - word_similarity(word, text)).cast("float")


def strict_word_distance(word: Column, text: Column) -> Column:
    return (F.lit(1.0).cast("float") - strict_word_similarity(word, text)).cast("float")


def pattern_column(pattern: Column, k: Column | int = 0, cost_ins: int = 1, cost_del: int = 1, cost_subst: int = 1) -> Column:
    """A struct of a pattern and its costs."""
    values = [pattern, F.lit(k) if isinstance(k, int) else k, F.lit(cost_ins), F.lit(cost_del), F.lit(cost_subst)]
    return F.struct(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, SCHEMA)))


#: The text form: a pattern without @, a maximal cost, and costs of insertion, deletion and substitution.
FORM = r"^([^@]*)(?:@\s*([0-9]+)\s*(?::\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*)?)?$"


def pattern_in(text: Column) -> Column:
    """A struct from the text form; other text is an error, null is null."""
    part = lambda k: F.regexp_extract(text, FORM, k)
    number = lambda k, other: F.when(part(k) == "", other).otherwise(part(k).cast("int"))
    values = [part(1), number(2, 0), number(3, 1), number(4, 1), number(5, 1)]
    made = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) if not isinstance(v, Column) else v.cast(f.dataType).alias(f.name) for v, f in zip(values, SCHEMA)))
    wrong = F.raise_error(F.concat(F.lit("bad pattern "), text)).cast(SCHEMA)
    return F.when(text.isNull(), F.lit(None).cast(SCHEMA)).when(text.rlike(FORM), made).otherwise(wrong)


def pattern_out(pattern: Column) -> Column:
    """The text form of a struct."""
    costs = F.concat_ws(",", *(pattern[c].cast("string") for c in ("cost_ins", "cost_del", "cost_subst")))
    return F.when(pattern["max_cost"] == 0, pattern["pattern"]).otherwise(F.concat(pattern["pattern"], F.lit("@"), pattern["max_cost"].cast("string"), F.when(costs == "1,1,1", "").otherwise(F.concat(F.lit(":"), costs))))


def parse_debug(pattern: str) -> str:
    return rx.dump(rx.parse(pattern))


def extract_debug(pattern: str, k: int = 0) -> str:
    """The prefilter of a pattern."""
    return f"k={k}\n" + prefilter.show(prefilter.formula(pattern, k))


def version() -> str:
    return VERSION


def _grouped(columns: list[pd.Series], one, kind: str) -> pd.Series:
    """one(pattern and further arguments, distinct texts) for each group of equal arguments; null where an argument is."""
    frame = pd.concat([c.reset_index(drop=True) for c in columns], axis=1, keys=range(len(columns)))
    out = pd.Series([None] * len(frame), dtype=kind)
    for given, rows in frame.dropna().groupby(list(range(1, len(columns))), sort=False):
        distinct = list(dict.fromkeys(rows[0]))
        found = dict(zip(distinct, one(given[0], *map(int, given[1:]), distinct)))
        out.loc[rows.index] = pd.array([found[t] for t in rows[0]], kind)
    return out


def _hinted(pattern: str, k: int, texts: list[str]) -> list[int | None]:
    """Costs, by the surroundings of pieces that a match must have, where the pattern has such."""
    return nfa.compiled(pattern).costs(texts, k, prefilter.pieces(prefilter.formula(pattern, k)))


TRIGRAMS = r"""array_distinct(flatten(transform(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'{1}', 0),
  w -> transform(sequence(1, char_length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"""


def register(spark: SparkSession) -> None:
    """SQL functions: scalar ones, and the table function amatch_detail for LATERAL joins.

    amatch, amatch_cost, amatch_weighted, text_distance and text_similarity work on batches, grouped by
    pattern; what needs no matcher is SQL that Spark inlines.  Patterns in text form, p@k, go to
    pattern_match, pattern_distance and pattern_similarity; Spark sorts by such functions only under
    a name of the select list.  Thresholds and the time limit are the session's at registration.
    """
    ensure(spark)
    timeout = setting("match_timeout_ms") / 1000 or None

    @F.pandas_udf("int")
    def cost(t: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        return _grouped([t, p, k], _hinted, "Int32")

    @F.pandas_udf("boolean")
    def hit(t: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        return _grouped([t, p, k], lambda q, n, texts: [c is not None for c in _hinted(q, n, texts)], "boolean")

    @F.pandas_udf("boolean")
    def weighted(t: pd.Series, p: pd.Series, k: pd.Series, i: pd.Series, d: pd.Series, s: pd.Series) -> pd.Series:
        def one(q, n, x, y, z, texts):
            if timeout is None:
                return [r is not None for r in nfa.compiled(q).costs(texts, n, weights=(x, y, z))]
            return [nfa.compiled(q).search(a, n, x, y, z, timeout) is not None for a in texts]

        return _grouped([t, p, k, i, d, s], one, "boolean")

    @F.pandas_udf("double")
    def alike(t: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        def one(q, n, texts):
            size = [max(len(a.encode()), len(q.encode())) for a in texts]
            return [0.0 if c is None else 1 - c / m if m else 1.0 for c, m in zip(_hinted(q, n, texts), size)]

        return _grouped([t, p, k], one, "Float64")

    @F.pandas_udf("string")
    def tree(p: pd.Series) -> pd.Series:
        return p.map(parse_debug, na_action="ignore")

    @F.pandas_udf("string")
    def extracted(p: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or pd.isna(b) else extract_debug(a, int(b)) for a, b in zip(p, k)])

    for name, f in {"amatch": hit, "amatch_cost": cost, "text_distance": cost, "amatch_weighted": weighted, "text_similarity": alike, "word_similarity": _extent(False), "strict_word_similarity": _extent(True), "parse_debug": tree, "extract_debug": extracted}.items():
        spark.udf.register(name, f)

    x, y = TRIGRAMS.format("a", trigrams.WORDS), TRIGRAMS.format("b", trigrams.WORDS)
    both, form = f"size(array_intersect({x}, {y}))", f"r'{FORM}'"
    part = lambda k, other: f"coalesce(nullif(regexp_extract(p, {form}, {k}), ''), '{other}')"
    valid = f"CASE WHEN p RLIKE {form} THEN regexp_extract(p, {form}, 1) WHEN p IS NULL THEN NULL ELSE raise_error(concat('bad pattern ', p)) END"
    for head, body in {
        "trgm_similarity(a STRING, b STRING) RETURNS FLOAT": f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(coalesce({both} / nullif(size(array_union({x}, {y})), 0), 0) AS FLOAT) END",
        "trgm_distance(a STRING, b STRING) RETURNS FLOAT": "CAST(1 AS FLOAT) - trgm_similarity(a, b)",
        f"trgm_sim_op(a STRING, b STRING, least DOUBLE DEFAULT {setting('similarity_threshold')}) RETURNS BOOLEAN": "CAST(trgm_similarity(a, b) AS DOUBLE) >= least",
        "word_distance(a STRING, b STRING) RETURNS FLOAT": "CAST(1 AS FLOAT) - word_similarity(a, b)",
        "strict_word_distance(a STRING, b STRING) RETURNS FLOAT": "CAST(1 AS FLOAT) - strict_word_similarity(a, b)",
        f"word_sim_op(a STRING, b STRING, least DOUBLE DEFAULT {setting('word_similarity_threshold')}) RETURNS BOOLEAN": "CAST(word_similarity(a, b) AS DOUBLE) >= least",
        f"strict_word_sim_op(a STRING, b STRING, least DOUBLE DEFAULT {setting('strict_word_similarity_threshold')}) RETURNS BOOLEAN": "CAST(strict_word_similarity(a, b) AS DOUBLE) >= least",
        f"pattern_in(p STRING) RETURNS {SCHEMA.simpleString()}": f"named_struct('pattern', {valid}, 'max_cost', CAST({part(2, 0)} AS INT), 'cost_ins', CAST({part(3, 1)} AS INT), 'cost_del', CAST({part(4, 1)} AS INT), 'cost_subst', CAST({part(5, 1)} AS INT))",
        "pattern_match(t STRING, p STRING) RETURNS BOOLEAN": f"amatch(t, {valid}, CAST({part(2, 0)} AS INT))",
        "pattern_distance(t STRING, p STRING) RETURNS INT": f"amatch_cost(t, {valid}, CAST({part(2, 0)} AS INT))",
        "pattern_similarity(t STRING, p STRING) RETURNS DOUBLE": f"text_similarity(t, {valid}, CAST({part(2, 0)} AS INT))",
        "textsieve_version() RETURNS STRING": f"'{VERSION}'",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.udtf(returnType=DETAIL)
    class Detail:
        def __init__(self):
            self.seen: dict = {}  # of the texts that came last

        def find(self, t: str, p: str, k: int):
            matcher = nfa.compiled(p)
            if timeout is None and k >= 0 and matcher.parallel((1, 1, 1)) and (k := matcher.least(t, k)) is None:
                return None
            return matcher.search(t, k, deadline=timeout)

        def eval(self, t: str, p: str, k: int):
            if t is None or p is None or k is None:
                return
            key = (t, p, k)
            if key not in self.seen:
                if len(t) > 1000:
                    found = self.find(t, p, k)
                    if found:
                        yield found
                    return
                if len(self.seen) >= 10_000:
                    self.seen.clear()
                self.seen[key] = self.find(t, p, k)
            if self.seen[key]:
                yield self.seen[key]

    spark.udtf.register("amatch_detail", Detail)
