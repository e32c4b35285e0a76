"""Documents with every awkward case, and brute-force statements of the operators."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = "size start length kind rank bucket token digest key k1 k2 x n words place block part starts text_key component label times copy failed score times_x".split()


def documents(seed=7, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(45)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90, 200]))]
        if i % 5 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append([i, " ".join(words), "en", f"s{i % 4}", 0])
    rows[11][1] = rows[10][1]  # a copy
    rows[12][1] = rows[10][1].replace(" ", "\n")  # the same words, other white space
    near = (rows[4][1] + " " + " ".join(vocabulary[:150])).split()
    rows[4][1] = " ".join(near)
    for i in (21, 22, 23, 24):  # near copies
        words = list(near)
        words[5 * (i - 20)] = "changed"
        rows[i][1] = " ".join(words)
    rows[30][1] = "Mentpa " * 120  # one long run
    rows[31][1] = "ab cd " * 100
    rows[32][1], rows[33][1], rows[34][1], rows[35][1] = None, "", " \t\n ", "one"
    rows[36][1] = " ".join(rng.choice(vocabulary) for _ in range(30_000))  # very long
    rows[37][1] = "x" * 50_000
    rows[38][3] = None
    rows[39][1] = "naïve café — ＡＢＣ 𠮷野   　 İstanbul <|endoftext|> end"
    rows.append([None, rows[10][1], "en", None, 0])  # no id
    rows.append(list(rows[10]))  # a repeated row
    rows.append([10, "another text with an id that is taken " + rows[4][1], "en", "s1", 0])
    return [tuple(r) for r in rows]


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


LAST = (1 << 63) - 1


def substring_dedup(rows, window=20):
    """(doc_id, n_words, n_removed, sha) per row, by a table of all windows."""
    first = {}
    texts = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, words in texts:
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            first[k] = min(first.get(k, (doc, s)), (doc, s))
    out = []
    for (doc, words), row in zip(texts, rows, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (doc, s):
                gone.update(range(s, s + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((row[0], len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(rows, threshold=85):
    """(row number, set size, component) by comparing all pairs of rows."""
    sets = [shingles(r[1]) for r in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                links.append((j, i))
    group = components(range(len(rows)), links)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[group[i]] = min(ids.get(group[i], r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(group[i], r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)
