"""Spelling variants: words one edit apart, found in a trie of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import ascii_lower, whole
from portolan.session import RoundTable, written

#: Words have so many letters and so many occurrences; a form has so many times the occurrences of its variant.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One run in so many loses a letter (a stand-in for misspellings).
ODDS = 199
#: Letter groups, one per level of the trie; letters of none (accented ones) fall into two more by their code point.
GROUPS = ("e", "a", "i", "n", "r", "t", "o", "s", "l", "uj", "cq", "dx", "pz", "mk", "hw", "gv", "bfy")
LEVELS = len(GROUPS) + 2
#: Words of a subtree that one task holds, at least and at most, subtrees aimed at, and queries that meet one at once.
LEAST, MOST, SUBTREES, QUERIES = 4096, 1 << 18, 2048, 1 << 14
#: Below so many words a node is compared whole; a node that more pairs reach is looked up by halves.
LEAF, PAIRS = 16, 1 << 16


def words_of(docs: DataFrame, odds: int = ODDS, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """``word, n``: runs of letters, lower case (A-Z only), of at least ``letters`` letters and ``least`` occurrences.

    Of a run whose crc32 with the doc_id divides by ``odds``, one letter goes first. Null texts have no runs, a null doc_id
    is empty in the checksum.
    """
    runs = F.regexp_extract_all(ascii_lower(whole()), F.lit(f"[a-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    size, run = F.char_length("run"), F.col("run")
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))
    word = F.when(F.col("h") % odds == 0, cut).otherwise(run)
    return each.select(word.alias("word")).where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def vectors(words: list[str]) -> np.ndarray:
    """How many letters of each group every word has."""
    table = np.arange(0x110000, dtype=np.uint8) % 2 + len(GROUPS)
    for g, letters in enumerate(GROUPS):
        table[[ord(c) for c in letters]] = g
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * LEVELS + table[points], minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def _spent(more: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Budgets after a level at which the trie has ``more`` letters than the query, and who is still within them."""
    surplus, deficit = surplus + np.maximum(more, 0), deficit - np.minimum(more, 0)
    ok = np.flatnonzero((surplus <= 1) & (deficit <= 1))
    return ok, surplus[ok], deficit[ok]


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the first letter that differs
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _by_halves(queries: list[str], asked: np.ndarray, words: list[str], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs one edit apart, where many meet: one edit leaves one half of a word as it is."""
    heads, tails = {}, {}
    for i in range(lo, hi):
        w, h = words[i], len(words[i]) // 2
        heads.setdefault((len(w), w[:h]), []).append(i)
        tails.setdefault((len(w), w[h:]), []).append(i)
    for q in asked.tolist():
        text, found = queries[q], set()
        for size in range(len(text) - 1, len(text) + 2):
            h = size // 2
            found.update(heads.get((size, text[:h]), ()), tails.get((size, text[len(text) - size + h :]), ()))
        yield from ((q, i) for i in found if one_edit(text, words[i]))


def search(queries: list[str], words: list[str]) -> tuple[list[int], list[int]]:
    """Pairs ``(query, word)`` one edit apart, by a depth-first search of the words' trie for all queries at once.

    Level by level a node splits by the count of one letter group. An edit adds a letter to one group at most and takes one from
    one at most, so a query goes on to children while it has spent a surplus of one and a deficit of one at most. Words at
    leaves are verified.
    """
    if not queries or not words:
        return [], []
    tree, asked = vectors(words), vectors(queries)
    order = np.lexsort(tree.T[::-1])
    tree, words = tree[order], [words[i] for i in order]
    left, right = [], []

    def visit(lo: int, hi: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        if hi - lo <= LEAF or level == LEVELS:
            if len(who) * (hi - lo) > PAIRS and level == LEVELS:
                pairs = _by_halves(queries, who, words, lo, hi)
            else:
                pairs = []
                for i in range(lo, hi):
                    more = tree[i, level:] - asked[who, level:]
                    ok = (surplus + np.maximum(more, 0).sum(1) <= 1) & (deficit - np.minimum(more, 0).sum(1) <= 1)
                    pairs += [(q, i) for q in who[ok].tolist() if one_edit(queries[q], words[i])]
            for q, i in pairs:
                left.append(q), right.append(int(order[i]))
            return
        column = tree[lo:hi, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo], strict=True):
            ok, s, d = _spent(column[a] - asked[who, level], surplus, deficit)
            if len(ok):
                visit(lo + a, lo + b, level + 1, who[ok], s, d)

    none = np.zeros(len(queries), np.int32)
    visit(0, len(words), 0, np.arange(len(queries)), none, none)
    return left, right


def subtrees(spelt: DataFrame, count: int, least: int = LEAST) -> list[tuple[tuple, int]]:
    """``(first counts, words)`` of the subtrees that tasks take, over ``spelt`` (``word, v``).

    A node with more words than a task takes is split by the next letter group, unless none is left. The list grows with
    ``count`` only until tasks are full: of `SUBTREES` nodes on every level no more are split.
    """
    most = min(max(least, count // SUBTREES), max(least, MOST))
    spark, found, heavy = spelt.sparkSession, [], [()] if count else []
    if count <= most:
        return [((), count)]
    for level in range(1, LEVELS + 1):
        inside = spelt
        if level > 1:
            split = F.broadcast(spark.createDataFrame([(list(p),) for p in heavy], "p array<int>"))
            inside = spelt.join(split, F.slice("v", 1, level - 1) == F.col("p"), "left_semi")
        nodes = [(tuple(r["p"]), r["n"]) for r in inside.groupBy(F.slice("v", 1, level).alias("p")).agg(F.count("*").alias("n")).collect()]
        full = level == LEVELS
        found += [x for x in nodes if full or x[1] <= most]
        heavy = [] if full else [p for p, n in nodes if n > most]
        if not heavy:
            break
    return found


def _reached(spelt: DataFrame, nodes: list[tuple[tuple, int]]) -> DataFrame:
    """``word, node, own``: the subtrees that each word's search goes into, and whether it is a word of it."""
    top: dict = {}
    for number, (prefix, _) in enumerate(nodes):
        at = top
        for c in prefix[:-1]:
            at = at.setdefault(c, {})
        if prefix:
            at[prefix[-1]] = number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            asked, parts = vectors(words), []

            def visit(node, level, who, surplus, deficit):
                if not isinstance(node, dict):
                    parts.append((who, np.full(len(who), node), (surplus == 0) & (deficit == 0)))
                    return
                for c, child in node.items():
                    ok, s, d = _spent(c - asked[who, level], surplus, deficit)
                    if len(ok):
                        visit(child, level + 1, who[ok], s, d)

            none = np.zeros(len(words), np.int32)
            visit(top or 0, 0, np.arange(len(words)), none, none)
            who, node, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(node.astype(np.int64)), pa.array(own)], ["word", "n", "node", "own"])

    return spelt.select("word", "n").mapInArrow(run, "word string, n long, node long, own boolean")


def near_words(words: DataFrame, count: int, least: int = LEAST) -> DataFrame:
    """``word, other, other_n``: every word of ``words`` (``word, n``) with every other one edit away, both ways.

    ``count`` is their number. The first levels of the trie are cut into subtrees; a word goes to its own and to those its search may
    enter. A subtree that no group can split is dealt out in blocks, and so are the words that search it,
    so no task holds more than a block of each.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors(batch.column(0).to_pylist())
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * LEVELS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], ["word", "n", "v"])

    spelt = written(words.select("word", "n").mapInArrow(spell, "word string, n long, v array<int>"), "spelt")
    nodes = subtrees(spelt, count, least)
    most = min(max(least, count // SUBTREES), max(least, MOST))
    reached = written(_reached(spelt, nodes), "reached")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    sizes = reached.groupBy("node").agg(blocks(F.count_if("own"), most).alias("held"), blocks(F.count("*"), max(least, QUERIES)).alias("asked"))
    # one row per subtree
    dealt = reached.join(F.broadcast(sizes), "node")
    part = lambda n: F.pmod(F.xxhash64("word"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    members = dealt.where("own").select("node", part(F.col("held")).alias("m"), every(F.col("asked")).alias("q"), "word", "n")
    queries = dealt.select(F.col("node").alias("of"), every(F.col("held")).alias("m"), part(F.col("asked")).alias("q"), F.col("word").alias("query")).toDF("of", "of_m", "of_q", "query")

    def match(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        q, i = search(asks["query"].tolist(), own["word"].tolist())
        return pd.DataFrame({"word": asks["query"].to_numpy(object)[q], "other": own["word"].to_numpy(object)[i], "other_n": own["n"].to_numpy()[i]})

    return members.groupBy("node", "m", "q").cogroup(queries.groupBy("of", "of_m", "of_q")).applyInPandas(match, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of every word's forms. A form is `TIMES` as frequent, so there are few steps."""
    done, left = RoundTable(forms.sparkSession, "roots"), RoundTable(forms.sparkSession, "steps")
    step = left.add(forms.select("word", F.col("form").alias("root")))
    onward = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    done.add(step.limit(0))
    while left.rows:
        both = written(step.join(onward, "root", "left"), "onward")
        done.add(both.where("next IS NULL").select("word", "root"))
        step = left.add(both.where("next IS NOT NULL").select("word", F.col("next").alias("root")))
    return done.all()


def groups(words: DataFrame, count: int, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word of ``words`` (``word, n``; ``count`` of them).

    A word's form is the most frequent word one edit away (ties: the smallest), if that has ``times`` the word's
    occurrences; its root is where forms lead.
    """
    near = near_words(words, count, least)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("has", -F.col("best.less") >= F.col("n") * times)
    named = joined.select(
        "word", F.when(F.col("has"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")
    )
    named = written(named, "forms")
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Words of whole texts with their form and root (`words_of`, `groups`); a corpus without such words gives no rows.

    Null texts have none, repeated rows count as often as they come, words may be of any length. Other columns are not looked at.
    """
    table = RoundTable(docs.sparkSession, "words")
    words = table.add(words_of(docs))
    return groups(words, table.rows, least=least)


ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n, string_split(id || ':' || run, '') AS chars FROM runs WHERE length(run) >= 6 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(chars, lambda ch:
           CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] ELSE [195::BIGINT, 0, 0, 0, 0, 0, 0, 0, unicode(ch)::BIGINT - 64, 0, 0, 0, 0, 0, 0, 0] END))),
           lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) AS h
  FROM counted),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.cut),
best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': hex(encode(other))}) AS top FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN -b.top.less >= 5 * w.n THEN decode(unhex(b.top.other)) END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN -b.top.less >= 5 * w.n THEN -b.top.less END::BIGINT AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
