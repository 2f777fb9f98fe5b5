"""Spelling variants (12): words one edit apart, found by a frontier that walks a relational trie.

The trie is a table of edges (node, first character, label, child); a node is a hash of its depth
and of the characters on the way to it, and only nodes with two and more continuations are kept, so
a label spans the characters up to the next one. There are two tries in one table, of the words and
of the reversed words: of two words one edit apart, the common prefix or the common suffix holds at
least half of the shorter word, so the walk may begin in the lower half, where few words share a node.

1. Words become steps (node, next character) per direction; nodes with two next characters branch.
2. A word's zero-edit states are its own path. At each branching node of its lower half it takes its
   one edit: another character for its own, or a further character (a missing one is the further
   character of the other word). The states (word, rest, node) that survive the label are the frontier.
   A state is taken only if the child has an edge for the next character of its rest.
3. Level by level the frontier is joined to the edge table on (node, next character). A state whose
   label leads to a word's end yields a pair; the others go on at the child. The loop ends with the
   frontier; it has as many rounds as branching nodes follow an edit.
4. Pairs are verified with ``levenshtein``. A word's near words are counted and its form (the most
   frequent near word, if frequent enough) is taken by an aggregation; roots by pointer doubling.

Nodes are joined with many states (words below a frequent beginning) but have at most one edge per
letter, so a hot node multiplies by the alphabet only and its states can be split over tasks.

Defined cases: a null text has no words; a null id deletes no character; repeated rows count again;
no words give an empty table; other columns are not read. Words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, is_empty, stage
from tessera.llm.registry import query, table
from tessera.llm.words import U, mix

#: Letters of the contract, × and ÷ included, as the range says.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form occurs this many times as often as its variant.
RATIO = 10


def _steps(batches) -> Iterator[pa.RecordBatch]:
    """(node, sym, word, n, back, depth) of every prefix and suffix of at least half a word, less one letter."""
    for b in batches:
        words = b.column(0).to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        row = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(codes)) - start[row]
        for back in (False, True):
            code = codes[start[row + 1] - 1 - at] if back else codes
            run = np.concatenate((np.zeros(1, U), np.cumsum(mix(code.astype(U) * U(0x9E3779B97F4A7C15) + at.astype(U)))))
            low = (size - 1) // 2
            many = size - low + 1  # depths low .. size
            of = np.repeat(np.arange(len(words)), many)
            depth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
            place = start[of] + depth
            node = mix(run[place] - run[start[of]] + mix(depth.astype(U) * U(2) + U(back)))
            sym = np.where(depth < size[of], code[np.minimum(place, len(code) - 1)], 0) if len(code) else depth
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(sym.astype(np.int32)), b.column(0).take(take), b.column(1).take(take),
                                              pa.array(np.full(len(of), back)), pa.array(depth.astype(np.int32))], names=["node", "sym", "word", "n", "back", "depth"])


def paths(vocabulary: DataFrame) -> DataFrame:
    """(word, n, back, s, path): s is the word or its reverse, path its branching nodes (depth, node) from the top."""
    steps = vocabulary.select("word", "n").mapInArrow(_steps, "node long, sym int, word string, n long, back boolean, depth int")
    fork = steps.groupBy("node").agg(F.min("sym").alias("a"), F.max("sym").alias("z")).where("a < z").select("node")
    own = steps.select("node", "word", "n", "back", "depth").join(fork, "node", "left_semi")
    path = own.groupBy("word", "n", "back").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    return path.withColumn("s", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))


def edges(path: DataFrame) -> DataFrame:
    """(node, sym, label, child, leaf, leaf_n, tail, next): one row per edge; an edge to a word's end has no child but the word.

    ``tail`` is the label without its first character, ``next`` holds the first characters of the child's edges."""
    def edge(x: Column, i: Column) -> Column:
        after = F.get("path", i + 1)
        size = F.coalesce(after["depth"], F.char_length("s")) - x["depth"]
        return F.struct(x["node"].alias("node"), F.substring(F.col("s"), x["depth"] + 1, size).alias("label"), after["node"].alias("child"),
                        F.when(after.isNull(), F.col("word")).alias("leaf"), F.when(after.isNull(), F.col("n")).alias("leaf_n"))
    rows = path.select(F.explode_outer(F.transform("path", edge)).alias("e")).select("e.*").distinct()
    rows = stage(rows.select("node", F.substring("label", 1, 1).alias("sym"), "label", "child", "leaf", "leaf_n", F.expr("substring(label, 2)").alias("tail")))
    ahead = rows.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(_sign(F.col("sym"))), "").alias("next"))
    inner = rows.where("child is not null").join(ahead, "child")
    last = rows.where("child is null").withColumn("next", F.lit(None).cast("string"))  # not joined: they would all meet on null
    return inner.select(*last.columns).unionByName(last)


#: Stands for the end of a word in ``next``.
END = "\n"


def _sign(c: Column) -> Column:
    return F.when(c == "", END).otherwise(c)


def _goes(rest: Column, label: Column) -> Column:
    """Whether the rest runs along the label to a word's end, or to the child and on from there."""
    on = F.instr(F.col("next"), _sign(F.substring(rest, F.char_length(label) + 1, F.lit(1)))) > 0
    return F.when(F.col("child").isNull(), rest == label).otherwise(rest.startswith(label) & on)


def _state(rest: Column, label: Column) -> Column:
    return F.struct("word", "n", F.substring(rest, F.char_length(label) + 1, F.char_length(rest)).alias("rest"), "child", "leaf", "leaf_n")


def first_states(path: DataFrame, edge: DataFrame) -> DataFrame:
    """States after the one edit, taken at the branching nodes of a word's lower half."""
    lower = F.filter("path", lambda x: x["depth"] >= F.floor(F.char_length("s") / 2))
    at = path.select("word", "n", "s", F.explode_outer(lower).alias("x")).where("x is not null")
    at = at.select("word", "n", F.col("x.node").alias("node"), F.expr("substring(s, x.depth + 1, 1)").alias("own"), F.expr("substring(s, x.depth + 2)").alias("less"), F.expr("substring(s, x.depth + 1)").alias("left"))
    less, left, tail = F.col("less"), F.col("left"), F.col("tail")
    other = (F.col("own") != "") & (F.col("sym") > F.col("own")) & _goes(less, tail)
    further = _goes(left, tail)
    both = at.join(edge, "node").where((F.col("sym") != "") & (F.col("sym") != F.col("own")) & (other | further))
    taken = F.array_compact(F.array(F.when(other, _state(less, tail)), F.when(further, _state(left, tail))))
    return both.select(F.explode(taken).alias("st")).select("st.*")


def next_states(states: DataFrame, edge: DataFrame) -> DataFrame:
    """One level down: the frontier meets the edges of its nodes that begin with the next character of the rest."""
    at = states.select("word", "n", "rest", F.col("child").alias("node"), F.substring("rest", 1, 1).alias("sym"))
    along = edge.select("node", "sym", "label", "child", "leaf", "leaf_n", "next")
    both = at.join(along, ["node", "sym"]).where(_goes(F.col("rest"), F.col("label")))
    return both.select(_state(F.col("rest"), F.col("label")).alias("st")).select("st.*")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of the words that are exactly one inserted, deleted or replaced code point apart."""
    path = stage(paths(vocabulary))
    edge = stage(edges(path))
    states = stage(first_states(path, edge))
    found = [states.where("child is null")]
    while not is_empty(states := states.where("child is not null")):
        states = stage(next_states(states, edge), release=len(found) < 3)  # the frontier shrinks fast
        found.append(states.where("child is null"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    once = pairs.select("word", "n", F.col("leaf").alias("near"), F.col("leaf_n").alias("near_n")).where(F.levenshtein("word", "leaf", 1) == 1)
    sides = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return once.select(F.explode(sides).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Every form is more frequent than its word, so chains end."""
    reached = stage(forms.select("word", F.col("form").alias("root")), release=False)
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stage(reached.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), release=False)
        reached = step.select("word", "root")
        if is_empty(step.where("moved")):
            return reached


def variant_forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per row of ``vocabulary`` (word, n; words distinct): word, form, root, n, n_near, form_n."""
    vocabulary = vocabulary.select("word", F.col("n").cast("long").alias("n"))
    best = near_pairs(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    rows = vocabulary.join(best, "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    rows = stage(rows.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")))
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """(id, run): the lower-cased maximal runs of ``least`` and more letters, one row per occurrence."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    found = docs.select(F.col(id_col).alias("id"), F.explode_outer(runs).alias("run")).where("run is not null")
    return found.select("id", ascii_lower(F.col("run")).alias("run"))


def with_slips(runs: DataFrame) -> DataFrame:
    """(word, n) of the query: about one run in 31 loses a character, by checksum of id and run; then words are counted."""
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.when(F.col("h") % 31 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(slipped.alias("word")).where(F.char_length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


#: Checksums byte by byte; words one edit apart share a word with one character deleted (both at one place, or one of them whole).
ORACLE = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS hx FROM k),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || substr(hx, i, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS h FROM x, t),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM d),
one AS (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM v a JOIN e b ON a.word = b.less UNION SELECT b.word, a.word, a.n FROM v a JOIN e b ON a.word = b.less),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM one QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, hex(encode(near))) = 1),
f AS MATERIALIZED (SELECT v.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
c AS (SELECT word, form AS last FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
z AS (SELECT c.word, arg_max(last, f.n) AS root FROM c JOIN f ON f.word = c.last GROUP BY c.word)
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN z ON z.word = f.word
"""


@query("op12_spelling_variants", ORACLE)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return variant_forms(stage(with_slips(letter_runs(table(spark, sf_dir, "documents")))))
