"""Spelling variants: words one edit apart, found by states that walk a trie of all words.

The trie is a table of edges. Nodes with one child that end no word are passed over, so an edge
carries a run of letters and a walk has as many levels as its path has branches. States (word,
position, node, edits) are joined with the edges level by level; a state that reaches the end of
its word and of a trie word with one edit makes them neighbours.

The top of a trie is dense, and an edit there would spawn states for every word and letter. One
edit leaves the first or the second half of a word as it was, so there are two tries, of the words
and of the reversed words, and walks start at the node of the first ``length // 2`` letters.

Nodes are named by 64-bit hashes of their letters. Two nodes of one name share their edges, which
only adds walks; neighbours are compared letter by letter at the end.

Defined cases: a null or empty text has no words; a null doc_id is written as empty; repeated rows
count again; an empty table gives no words. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import small_batches, stored, text_slices
from haulmark.llm.words import _LOWER, U64, joined, mix

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0xC3] = True
#: Words that a task holds with their counts before it hands them on.
HELD_WORDS = 200_000
#: Rows that leave Python at a time.
BATCH_ROWS = 50_000


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31) -> DataFrame:
    """``word`` and its number of occurrences ``n``.

    A run whose crc32 of ``<doc_id>:<run>`` is divisible by ``damage`` loses the letter at that
    number modulo its length, which plants misspellings; 0 plants none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in text_slices(batches):
            _count(batch.column("text"), batch.column("doc_id").to_pylist(), least_length, damage, counts)
            if len(counts) > HELD_WORDS:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _count(texts: pa.Array, ids: list[str | None], least_length: int, damage: int, counts: dict[bytes, int]) -> None:
    """Add the words of some texts to ``counts``: runs are cut in numpy, only long ones become strings."""
    data, starts = joined(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    # In UTF-8 the byte C3 leads the characters U+00C0 to U+00FF and no others.
    inside[2:] |= np.append(data[:-1] == 0xC3, False)
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    second = np.concatenate([[0], np.cumsum(data == 0xC3)])
    long_ = end - begin - (second[end] - second[begin]) >= least_length
    begin, end = begin[long_], end[long_]
    owner = np.searchsorted(starts, begin, "right") - 1
    seeds = [zlib.crc32(f"{i or ''}:".encode()) for i in ids]
    whole = data.tobytes()
    for a, b, t in zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True):
        word = whole[a:b]
        if damage:
            h = zlib.crc32(word, seeds[t])
            if h % damage == 0:
                letters = word.decode()
                cut = h % len(letters)
                if len(letters) == least_length:
                    continue
                word = (letters[:cut] + letters[cut + 1 :]).encode()
        counts[word] = counts.get(word, 0) + 1


def _prefixes(words: DataFrame) -> DataFrame:
    """A row per word, direction and prefix that a walk can meet: ``size`` letters, ``node``, and the letter that follows.

    Walks end in words of their own length or one letter less, so none starts before ``length // 2``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _prefix_rows(batch.column("id").to_numpy(), batch.column("word").to_pylist())

    return words.select("id", "word").mapInArrow(run, "id long, back boolean, size int, node long, follows int, length int")


def _prefix_rows(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """All words go one letter further at a time, in both directions; rows leave in batches."""
    lengths = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(U64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    names = ["id", "back", "size", "node", "follows", "length"]
    parts: list[tuple] = []
    held = 0
    for back in (False, True):
        h, alive, p = np.full(len(texts), 17 + back, U64), np.arange(len(texts)), 0
        while len(alive):
            at = first[alive] + (lengths[alive] - 1 - p if back else p)
            more = p < lengths[alive]
            wanted = p >= lengths[alive] // 2
            some = alive[wanted]
            if len(some):
                follows = np.where(more, letters[np.clip(at, 0, len(letters) - 1)].astype(np.int64), -1)[wanted]
                node = mix(h[some] + U64(p)).view(np.int64)
                parts.append((ids[some], np.full(len(some), back), np.full(len(some), p, np.int32), node, follows.astype(np.int32), lengths[some].astype(np.int32)))
                held += len(some)
            if held > BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)
                parts, held = [], 0
            alive, at = alive[more], at[more]
            with np.errstate(over="ignore"):
                h[alive] = mix(h[alive] * U64(0xD6E8FEB86659FD93) ^ letters[at])
            p += 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between the nodes that branch, end a word or start a walk; and the states that start."""
    prefixes = stored(_prefixes(words))
    starts, ends = F.col("size") == F.expr("length div 2"), F.col("follows") < 0
    nodes = prefixes.groupBy("node").agg(F.max(starts | ends).alias("_stays"), F.min("follows").alias("_lo"), F.max("follows").alias("_hi"))
    nodes = stored(nodes.filter("_stays OR _lo < _hi").select("node"))
    kept = prefixes.join(nodes, "node", "left_semi")
    paths = kept.groupBy("id", "back").agg(F.sort_array(F.collect_list(F.struct("size", "node"))).alias("path"))
    said = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    paths = stored(paths.join(words, "id").select("n", "back", said.alias("w"), "path"))
    steps = paths.withColumn("i", F.explode(F.expr("sequence(0, size(path) - 2)"))).filter("i >= 0 AND i < size(path) - 1")
    steps = steps.selectExpr(
        "path[i].node AS node", "path[i + 1].node AS child", "path[i + 1].size AS size", "char_length(w) AS length",
        "substring(w, path[i].size + 1, path[i + 1].size - path[i].size) AS said",
        "CASE WHEN path[i + 1].size = char_length(w) THEN struct(w AS near, n AS near_n) END AS ending",
    )
    edges = stored(steps.groupBy("node", "child", "size", "said").agg(
        F.min("length").alias("shortest"), F.max("length").alias("longest"), F.collect_set("ending").alias("endings")
    ).withColumn("letter", F.substring("said", 1, 1)))
    # The letters that can follow an edge, to end hopeless walks early; no more than the alphabet has.
    after = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("letter"), "").alias("after"))
    edges = stored(edges.join(after, "child", "left").withColumns({"after": F.coalesce("after", F.lit("")), "m": F.char_length("said")}))
    half = "char_length(w) div 2"
    states = paths.selectExpr("w", "n", "back", f"int({half}) AS position", f"filter(path, x -> x.size = {half})[0].node AS node", "0 AS edits")
    return edges, states


#: What a state without edits becomes on an edge that says ``said`` (m letters): the letters it takes, and its edits.
#: Of two words of one length the walk is that of the one with the smaller letter, else that of the longer word.
_STEPS = """
filter(array(
  CASE WHEN substring(w, position + 1, m) = said THEN struct(position + m AS position, 0 AS edits) END,
  CASE WHEN rest >= m AND substring(w, position + 1, m) < said AND (m = 1 OR levenshtein(substring(w, position + 1, m), said, 1) = 1)
       THEN struct(position + m AS position, 1 AS edits) END,
  CASE WHEN rest > m AND contains(substring(w, position + 1, 2), letter) AND levenshtein(substring(w, position + 1, m + 1), said, 1) = 1
       THEN struct(position + m + 1 AS position, 1 AS edits) END
), x -> x IS NOT NULL)
"""


def near_words(words: DataFrame) -> DataFrame:
    """Ordered pairs ``word``, ``near`` of words one edit apart, with ``near_n``; ``words`` has ``id`` (unique), ``word``, ``n``."""
    edges, states = _trie(words)
    state, found = ["w", "n", "back", "position", "node", "edits"], []
    while True:
        length = F.char_length("w")
        fresh = states.filter("edits = 0").join(edges, "node").withColumn("rest", length - F.col("position"))
        fresh = fresh.filter((length >= F.col("shortest")) & (length - 1 <= F.col("longest"))).withColumn("to", F.explode(F.expr(_STEPS)))
        # After its edit a walk can only go where its next letter leads.
        spent = states.filter("edits = 1").withColumn("letter", F.substring("w", F.col("position") + 1, F.lit(1))).join(edges, ["node", "letter"])
        spent = spent.filter("substring(w, position + 1, m) = said").withColumn("to", F.struct((F.col("position") + F.col("m")).alias("position"), "edits"))
        columns = ["w", "n", "back", "to.position AS position", "child AS node", "to.edits AS edits", "size", "shortest", "longest", "after", "endings"]
        moved = fresh.selectExpr(*columns).unionByName(spent.selectExpr(*columns))
        # Some word below has the length that is left, and a letter that goes on, or the walk ends in a word.
        left = length - F.col("position")
        full = F.col("size") + left
        ends = (left == 0) & (F.size("endings") > 0)
        goes_on = (left > 0) & F.contains("after", F.substring("w", F.col("position") + 1, F.lit(1)))
        spent_on = (full >= F.col("shortest")) & (full <= F.col("longest")) & (ends | goes_on)
        fresh_on = (full >= F.col("shortest")) & (full - 1 <= F.col("longest")) & (left > 0)
        moved = moved.filter(F.when(F.col("edits") == 1, spent_on).otherwise(fresh_on))
        done = (F.col("edits") == 1) & (F.char_length("w") == F.col("position"))
        level = stored(moved.select(*state, F.when(done, F.col("endings")).alias("endings")))
        found.append(level.filter("endings IS NOT NULL").select("w", "n", "back", F.inline("endings")))
        states = level.filter("endings IS NULL").drop("endings")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    turn = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(turn("w").alias("word"), "n", turn("near").alias("near"), "near_n").distinct()
    pairs = stored(pairs.filter("levenshtein(word, near, 1) = 1"))
    return pairs.select("word", "near", "near_n").unionByName(pairs.selectExpr("near AS word", "word AS near", "n AS near_n"))


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31, ratio: int = 10) -> DataFrame:
    """``word``, ``n``, ``n_near``, and the ``form`` and ``root`` it may be a variant of, with ``form_n``.

    The form is the near word that occurs most (ties: the first in code-point order) if it occurs at least
    ``ratio`` times as often. The root is reached from form to form. Words have at least three letters.
    """
    if least_length < 3:
        raise ValueError("words of at least three letters")
    small_batches(docs.sparkSession)
    counted = count_words(docs, least_length, least_count, damage)
    words = stored(stored(counted).withColumn("id", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.select("word", "n").join(near, "word", "left")
    is_form = -F.col("best.minus") >= F.col("n") * ratio
    told = stored(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ))
    roots = _roots(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """The last word of each chain, each round jumping twice as far; counts rise along a chain, so none is a circle."""
    links = stored(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        jumped = stored(links.join(onward, "root", "left"))
        if jumped.filter("_far IS NOT NULL").isEmpty():
            return links
        links = jumped.select("word", F.coalesce("_far", "root").alias("root"))
