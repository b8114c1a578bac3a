"""Dictionaries of phrases in running text: at each place the longest phrase that begins there is replaced, from left to right, and what was replaced isn't looked at again.

A counted dictionary goes out as a trie, written as one pattern, with its meanings in a small hash table: each text is cut into phrases and runs between them in one pass.
A larger one stays a table: the places of a text that can begin a phrase are joined with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of a dictionary that goes out as a pattern at most, and buckets of its table.
MOST, BUCKETS = 5_000, 256


def trie_pattern(phrases) -> str:
    """A pattern that matches the longest of the phrases: common beginnings are written once, and whatever goes on is tried before the end."""
    trie: dict = {}
    for p in phrases:
        at = trie
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        parts = [re.escape(c) + written(node[c]) for c in sorted(node) if c]
        if not parts:
            return ""
        return ("(?:" + "|".join(parts) + ")") + ("?" if "" in node else "") if len(parts) > 1 or "" in node else parts[0]

    return written(trie)


class Phrases:
    """A dictionary as column expressions. The empty phrase is left out; meanings may be empty. whole_words: a phrase neither begins nor ends within a run of letters and digits."""

    def __init__(self, meanings: Mapping[str, str], whole_words: bool = False):
        self.meanings = {k: v for k, v in meanings.items() if k}
        if len(self.meanings) > MOST:
            raise ValueError(f"{len(self.meanings)} phrases; over {MOST} replaced_by_table takes them")
        found = trie_pattern(self.meanings)
        self.whole_words, self.found = whole_words, None
        found = rf"(?<![\p{{L}}\p{{N}}]){found}(?![\p{{L}}\p{{N}}])" if whole_words and found else found
        self.found = found or None
        begin = "".join(sorted({re.escape(p[0]) for p in self.meanings}))
        # A phrase, else a run of what begins none, else one character.
        self.pattern = rf"(?s)({found})|[^{begin}]+|." if found else "(?s).+"
        table: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
        for k, v in self.meanings.items():
            table[_bucket(k)][k] = v
        self.table = json.dumps(table, ensure_ascii=False)

    def meaning(self, piece: Column) -> Column:
        """The meaning of a phrase, null for other pieces. The table is one literal, and its bucket is found by a checksum, so no list is searched."""
        table = F.from_json(F.lit(self.table), "array<map<string,string>>")
        return F.try_element_at(F.get(table, (F.crc32(F.encode(piece, "UTF-8")) % BUCKETS).cast("int")), piece)

    def pieces(self, text: Column) -> Column:
        """array<struct<p, m>>: the pieces of a text in order, with the meaning of those that are phrases. Within words a piece that looks like a phrase may be none, so with
        whole_words the pattern says which are."""
        all_of = F.regexp_extract_all(text, F.lit(self.pattern), 0)
        if not self.whole_words:
            return F.transform(all_of, lambda p: F.struct(p.alias("p"), self.meaning(p).alias("m")))
        both = F.arrays_zip(all_of.alias("p"), F.regexp_extract_all(text, F.lit(self.pattern), 1).alias("f"))
        return F.transform(both, lambda x: F.struct(x["p"].alias("p"), F.when(x["f"] != "", self.meaning(x["p"])).alias("m")))

    def replaced(self, text: Column) -> Column:
        """The text with each phrase's meaning in its place; null stays null."""
        # A text without any phrase isn't cut up.
        return F.when(text.rlike(self.found), self.joined(self.pieces(text))).otherwise(text) if self.meanings else text

    def joined(self, pieces: Column) -> Column:
        """The text of its pieces, each phrase's meaning in its place."""
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(x["m"], x["p"])), "")

    def counted(self, pieces: Column) -> Column:
        """How many of the pieces are phrases."""
        return F.size(F.filter(pieces, lambda x: x["m"].isNotNull()))

    def count(self, text: Column) -> Column:
        """How many phrases are replaced."""
        return self.counted(self.pieces(text)) if self.meanings else F.when(text.isNotNull(), 0)

    def replaced_in_json(self, raw: Column) -> Column:
        """JSON text with phrases replaced in its string values, of any nesting; names of fields, numbers and the rest of the text stay as they are written. Text that is no
        JSON stays."""
        pieces = F.regexp_extract_all(raw, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"(?:\s*:)?|[^"]++|"'), 0)
        escaped = lambda x: F.contains(x, F.lit("\\"))
        written = Phrases({k: _in_json(v) for k, v in self.meanings.items()}, self.whole_words)

        def put(piece: Column) -> Column:
            inner = F.get_json_object(F.concat(F.lit("["), piece, F.lit("]")), "$[0]")
            out = F.to_json(F.array(self.replaced(inner)))
            read = F.coalesce(F.substr(out, F.lit(2), F.length(out) - 2), piece)
            value = F.startswith(piece, F.lit('"')) & F.endswith(piece, F.lit('"')) & (F.length(piece) > 2)
            if not self.meanings:
                return F.when(value, read).otherwise(piece)
            # A text without escapes is what it says; others are read and written as JSON.
            plain = F.concat(F.lit('"'), written.joined(written.pieces(F.substr(piece, F.lit(2), F.length(piece) - 2))), F.lit('"'))
            return F.when(~value | (~escaped(piece) & ~piece.rlike(self.found)), piece).when(~escaped(piece), plain).otherwise(read)

        whole = F.when(F.try_parse_json(raw).isNotNull(), F.array_join(F.transform(pieces, put), "")).otherwise(raw)
        return F.when(~escaped(raw) & ~raw.rlike(self.found), raw).otherwise(whole) if self.meanings else whole


def _in_json(text: str) -> str:
    """A text as it stands between the quotes of JSON, in the form that Spark writes."""
    return "".join(f"\\u{ord(c):04X}" if c < " " and c not in "\b\t\n\f\r" else json.dumps(c, ensure_ascii=False)[1:-1] for c in text)


def _bucket(phrase: str) -> int:
    import zlib

    return zlib.crc32(phrase.encode()) % BUCKETS


def replaced(df: DataFrame, column: str, words: DataFrame, whole_words: bool = False, key: str | None = None) -> DataFrame:
    """df with the phrases of a dictionary (word, meaning) replaced in a column; of several meanings of a word the least counts. The dictionary is collected only if it has
    MOST rows at most (counted, stopping one beyond); a larger one is joined, for which `key` must name each row."""
    one = words.filter("word != '' AND meaning IS NOT NULL").groupBy("word").agg(F.min("meaning").alias("meaning"))
    some = one.limit(MOST + 1).collect()
    if len(some) <= MOST:
        return df.withColumn(column, Phrases({r.word: r.meaning for r in some}, whole_words).replaced(F.col(column)))
    if key is None:
        raise ValueError(f"over {MOST} phrases: name the key of a row")
    return replaced_by_table(df, column, one, key, whole_words)


def replaced_by_table(df: DataFrame, column: str, words: DataFrame, key: str, whole_words: bool = False) -> DataFrame:
    """The same for a dictionary of any size (word, meaning; each word once): every place of a text meets the phrases of its first characters in an equi-join, and of the
    phrases that fit there the longest counts. The rows of a text are folded from left to right. Rows of a null key or text stay."""
    head = F.lit(words.agg(F.min(F.length("word")).alias("n")).first().n or 1)  # one number: the characters that every phrase has
    d = words.select("word", "meaning", F.substr("word", F.lit(1), head).alias("_head"), F.length("word").alias("_n"))
    text = F.col(column)
    places = df.filter(text.isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), text.alias("_t"), F.explode(F.sequence(F.lit(1), F.greatest(F.length(text) - head + 1, F.lit(1)))).alias("_at"))
    places = places.withColumn("_head", F.substr("_t", F.col("_at"), head)).join(d, "_head")
    fits = F.substr("_t", F.col("_at"), F.col("_n")) == F.col("word")
    if whole_words:
        edge = lambda c: ~F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))
        fits = fits & edge(F.when(F.col("_at") > 1, F.substr("_t", F.col("_at") - 1, F.lit(1)))) & edge(F.substr("_t", F.col("_at") + F.col("_n"), F.lit(1)))
    best = places.filter(fits).groupBy("_key", "_at").agg(F.max_by(F.struct("_n", "meaning"), "_n").alias("b"))
    per = best.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "b._n", "b.meaning"))).alias("_found"))
    taken = F.aggregate(F.col("_found"), F.array().cast("array<struct<_at:int,_n:int,meaning:string>>"), lambda got, x: F.when(F.coalesce(F.try_element_at(got, F.lit(-1))["_at"] + F.try_element_at(got, F.lit(-1))["_n"], F.lit(0)) > x["_at"], got).otherwise(F.concat(got, F.array(x))))
    per = per.withColumn("_found", taken)
    ends = F.concat(F.array(F.lit(1)), F.transform("_found", lambda x: x["_at"] + x["_n"]))
    between = F.transform("_found", lambda x, i: F.concat(F.substr(column, F.get(ends, i), x["_at"] - F.get(ends, i)), x["meaning"]))
    whole = F.concat(F.array_join(between, ""), F.substr(column, F.element_at(ends, -1)))
    return df.join(per, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce(F.when(F.col("_found").isNotNull(), whole), F.col(column))).drop("_key", "_found")
