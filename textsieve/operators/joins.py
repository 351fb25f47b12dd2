"""Joins by approximate match and by similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.functions import columns as c
from textsieve.functions import nfa
from textsieve.functions import trigrams as t
from textsieve.sources.index import characters, windows
from textsieve.sources.tables import spread


def pieces(pattern: Column, k: int) -> Column:
    """A literal pattern cut into k + 1 pieces, one of which a match of at most k edits leaves unharmed."""
    n = F.char_length(pattern)
    size = F.floor(n / (k + 1)).cast("int")
    cut = lambda i: pattern.substr(F.lit(i) * size + 1, size if i < k else n - F.lit(i) * size)
    return F.array(*[cut(i) for i in range(k + 1)])


def substrings(text: Column, q: int) -> Column:
    """The distinct parts of q characters."""
    return windows(characters(text), q)


def fuzzy_join(left: DataFrame, right: DataFrame, text: str, word: str, k: int, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, dist) of pairs where right[word], a literal, matches in left[text] within k edits.

    Rows meet on the grams of q characters that begin a piece of the word, for the q that the
    shortest piece has; words of k characters or fewer match everything and meet all texts.
    """
    left = left.select(F.col(left_key).alias("__l"), F.col(text).alias("__t")).where("__t IS NOT NULL")
    right = right.select(F.col(right_key).alias("__r"), F.col(word).alias("__w")).where("__w IS NOT NULL")
    size = F.least(F.floor(F.char_length("__w") / (k + 1)), F.lit(4)).cast("int")
    words = right.withColumn("__q", size)
    cut = words.where("__q > 0").select("__r", "__w", "__q", F.explode(F.transform(pieces(F.col("__w"), k), lambda p: p.substr(F.lit(1), F.col("__q")))).alias("__g")).distinct()
    # lengths of grams that no word has aren't emitted: the join is on grams alone, and few words are short
    sizes = [r[0] for r in words.where("__q > 0").select("__q").distinct().collect()]  # 1 to 4
    grams = F.flatten(F.array(*[substrings(F.col("__t"), q) for q in sorted(sizes) or [1]]))
    met = left.select("__l", F.explode(grams).alias("__g")).join(cut, "__g").select("__l", "__r").distinct()
    short = words.where("__q = 0").select("__r", "__w")
    pairs = met.join(left, "__l").join(right, "__r").withColumn("dist", levenshtein_in("__t", "__w", k))
    every = left.select("__l").join(short, F.lit(True)).select("__l", "__r", F.char_length("__w").alias("n"))
    if short.head(1):
        texts = every.join(left, "__l").join(right, "__r").withColumn("dist", levenshtein_in("__t", "__w", k))
        pairs = pairs.unionByName(texts.select(*pairs.columns))
    return pairs.where("dist IS NOT NULL").select(F.col("__l").alias(left_key), F.col("__r").alias(right_key), "dist")


def levenshtein_in(text: str, word: str, k: int) -> Column:
    """Least edits, at most k, to find a literal word in a text, both columns."""
    c._ready()

    @F.pandas_udf("int")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="Int32")
        for w, rows in texts.groupby(words).groups.items():
            escaped = "".join("\\" + x if x in "\\.[](){}*+?^$|" else x for x in w)
            out.loc[rows] = pd.array(nfa.compiled(escaped).costs(texts.loc[rows].to_list(), k), "Int32")
        return out

    return run(F.col(text), F.col(word))


#: Most trigrams of a row that are paired; rows with more to look at meet on single ones.
MOST_PAIRED = 12

#: Rows of a class, about, that are told together when pairs of rows are.
BLOCK = 256


def _sets(df: DataFrame, text: str, key: str) -> DataFrame:
    """(__k, __s) of rows that have trigrams: the key, which may be null, and the trigrams in order."""
    return df.select(F.col(key).alias("__k"), F.sort_array(t.trigrams(F.col(text))).alias("__s")).where("size(__s) > 0")


def _similar(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(__l, __r, similarity) of different sets (__c, __s) of x and of y that are at least so similar.

    Sets meet on the rarest of their trigrams.  Two that are similar enough have no fewer than
    o = ceil(threshold * n) trigrams in common, for the n of either, so the n - o + 1 rarest of one
    and of the other have one in common, and the n - o + 2 rarest have two, if o is two or more.
    Where these are few, their pairs are met on, which far fewer sets share than one of them.
    """
    often = x.select(F.explode("__s").alias("g")).unionByName(y.select(F.explode("__s").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, side: str) -> DataFrame:
        each = df.select("__c", F.explode("__s").alias("g")).join(often, "g")
        own = each.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s"))  # a row's own trigrams
        n = F.size("s")
        least = F.greatest(F.ceil(F.lit(threshold - 1e-6) * n).cast("int"), F.lit(1))
        wide = n - least + 2
        return own.select(F.col("__c").alias(side), n.alias(f"n{side}"), F.slice(F.col("s")["g"], F.lit(1), wide).alias("g"), ((least >= 2) & (wide <= MOST_PAIRED)).alias(f"p{side}"), wide.alias("w"))

    def single(df: DataFrame, side: str) -> DataFrame:
        return df.select(side, f"n{side}", f"p{side}", F.explode(F.slice("g", F.lit(1), F.col("w") - 1)).alias("m"))

    def paired(df: DataFrame, side: str) -> DataFrame:
        two = F.flatten(F.transform("g", lambda a, i: F.transform(F.slice(F.col("g"), i + 2, F.size("g")), lambda b: F.concat(a, b))))
        return df.where(f"p{side}").select(side, f"n{side}", F.explode(two).alias("m"))

    u, v = rare(x, "__l"), rare(y, "__r")
    sizes = F.least("n__l", "n__r") >= F.greatest("n__l", "n__r") * (threshold - 1e-6)
    met = paired(u, "__l").join(paired(v, "__r"), "m").where(sizes).select("__l", "__r")
    met = met.unionByName(single(u, "__l").join(single(v, "__r"), "m").where(sizes & ~(F.col("p__l") & F.col("p__r"))).select("__l", "__r")).distinct()
    both = F.size(F.array_intersect("__x", "__y"))
    similarity = (both / (F.size("__x") + F.size("__y") - both)).cast("float")
    pairs = met.join(x.select(F.col("__c").alias("__l"), F.col("__s").alias("__x")), "__l").join(y.select(F.col("__c").alias("__r"), F.col("__s").alias("__y")), "__r")
    return pairs.withColumn("similarity", similarity).where(F.col("similarity").cast("double") >= threshold).select("__l", "__r", "similarity")


def _classes(rows: DataFrame) -> DataFrame:
    """(__c, __s, __n): each set once, the least key that has it, with a hash as a key may have several, and how many rows have it."""
    return rows.groupBy("__s").agg(F.min("__k").alias("k"), F.count("*").alias("__n")).select(F.struct("k", F.xxhash64("__s").alias("h")).alias("__c"), "__s", "__n")


def similarity_classes(left: DataFrame, right: DataFrame, a: str, b: str, left_key: str, right_key: str, threshold: float = 0.3) -> DataFrame:
    """(left_key, class_id, right_key, n_right, similarity): each left row, its class, and each class of right rows that is at least so similar.

    Rows of one set of trigrams are a class, named by its least key, so keys have to be unique; n_right
    rows are in the right one.  Rows of a class are not paired with each other, even if their texts
    differ: every row of a class is as similar to every row of the other, and class_members has the
    right rows.  similarity_join tells all pairs of rows.
    """
    x, y = _sets(left, a, left_key), _sets(right, b, right_key)
    u, v = _classes(x), _classes(y)
    pairs = _similar(u, v, threshold).join(v.select(F.col("__c").alias("__r"), "__n"), "__r")
    found = pairs.join(u.select(F.col("__c").alias("__l"), "__s"), "__l").join(x, "__s")
    return found.select(F.col("__k").alias(left_key), F.col("__l.k").alias("class_id"), F.col("__r.k").alias(right_key), F.col("__n").alias("n_right"), "similarity")


def class_members(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, class_id) of the rows that have trigrams: the class, as similarity_classes names it, that each is in."""
    rows = _sets(df, text, key)
    return _classes(rows).join(rows, "__s").select(F.col("__k").alias(key), F.col("__c.k").alias("class_id"))


def _blocks(rows: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    """(side, keys): the keys of each class's rows, in blocks of about BLOCK; rows of one key stay together."""
    block = F.pmod(F.xxhash64("__k"), F.ceil(F.col("__n") / BLOCK))
    each = classes.join(rows, "__s").groupBy(F.col("__c").alias(side), block.alias("b"))
    return each.agg(F.collect_list(F.struct("__k")).alias(f"k{side}")).drop("b")  # structs, as null keys would be left out


def similarity_join(left: DataFrame, right: DataFrame, a: str, b: str, left_key: str, right_key: str, threshold: float = 0.3) -> DataFrame:
    """(left_key, right_key, similarity) of pairs whose trigram similarity is at least the threshold.

    Classes of equal trigrams are compared, as in similarity_classes, and then told as pairs of their
    rows, of which copies have as many as the square of their number: each block of a class's rows
    with each of the other's, dealt to all cores.
    """
    x, y = _sets(left, a, left_key), _sets(right, b, right_key)
    u, v = _classes(x), _classes(y)
    met = _similar(u, v, threshold).join(_blocks(x, u, "__l"), "__l").join(_blocks(y, v, "__r"), "__r")
    rows = spread(met.select("k__l", "k__r", "similarity")).withColumn("l", F.explode("k__l")).withColumn("r", F.explode("k__r"))
    return rows.select(F.col("l.__k").alias(left_key), F.col("r.__k").alias(right_key), "similarity")
