"""Small tables and brute-force twins for the text operators."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, n_words string, bucket int"
LABELS = "doc_id long, quality int, toxic int, score double"
WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names operators also use."""
    full = [(i, t, lang, s, None if t is None else len(t), 7, 0.5, "x", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def hard_rows():
    """Nulls everywhere, empty and blank texts, one very long text, repeated rows and a repeated id."""
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    long_ = " ".join(rng.choice(WORDS) for _ in range(30_000))
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "fr", "b"),
        (5, " \t\n\x0b\x0c\r", "fr", None), (None, base, "en", "b"), (6, long_, "en", "c"), (7, long_ + " end", "en", "c"),
        (8, "one", "de", "a"), (9, "one two", "de", "a"), (9, "another text of the same id", "de", "a"), (10, "été 中文 \U0001f600", "zz", "a"),
        (None, None, None, None), (11, "123 456 !!! |", "en", "a"),
    ]


def random_texts(n, seed=1, low=5, high=150):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def cut_by_brute_force(rows, window):
    """(doc_id, words, removed, sha256) by comparing all windows."""
    place = {}
    for i, text in rows:
        ws = words(text)
        for k in range(len(ws) - window + 1):
            place.setdefault(tuple(ws[k : k + window]), set()).add(i)
    out = []
    for i, text in rows:
        ws = words(text)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if min(place[tuple(ws[k : k + window])]) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def components_by_brute_force(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
