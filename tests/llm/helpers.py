"""Small tables, and plain Python that says what the operators must return."""

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Beside the columns of documents, some with names that the operators use themselves.
CLASHING = "found row text_hash part blob words node size label score shingles spans r_doc_id".split()


def schema(clashing=False):
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    if clashing:
        fields += [T.StructField(name, T.StringType()) for name in CLASHING]
    return T.StructType(fields)


def documents(spark, rows, clashing=False, partitions=3):
    """Rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]))
        + (("x",) * len(CLASHING) if clashing else ())
        for r in rows
    ]
    return spark.createDataFrame(full, schema(clashing)).repartition(partitions)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def prose(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(count)]


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One two.",
    "a b\x1cc Été 漢字 \x85x",
    "same same same same same same same same same same same same",
    "UPPER lower UPPER lower !!! ### $$$ \n\n| a | b |\n| a | b |",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- one for each contract ------------------------------------------------------------


def shingle_set(text, k):
    words = (text or "").translate(ASCII_LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similar_components(rows, k, percent):
    """[(n_shingles, component number or None)] in the order of rows, by comparing all pairs."""
    sets = [shingle_set(text, k) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    return [(len(s), find(i) if s else None) for i, s in enumerate(sets)]


def contamination(rows, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(ASCII_LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(item)
    out = []
    for _, text in rows:
        words = pattern.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(words), len(hit), len(ids), ids))
    return out


def base_spans(text):
    text = text or ""
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII,
    )
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out)]


def rule_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    triples = list(zip(words, words[1:], words[2:]))
    count = collections.Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if count[t] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def without_repeats(rows, window=20):
    """{index of row: (n_words, n_removed, kept)}; rows of equal id and text get one result."""
    order = sorted(
        range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "")
    )
    seen, out, done = {}, {}, {}
    for i in order:
        key = rows[i]
        if key not in done:
            words = [w.decode() for w in (rows[i][1] or "").encode().split()]
            stays = [True] * len(words)
            for s in range(len(words) - window + 1):
                w = tuple(words[s : s + window])
                if w in seen:
                    stays[s : s + window] = [False] * window
                else:
                    seen[w] = i
            kept = [w for w, stay in zip(words, stays) if stay]
            done[key] = (len(words), len(words) - len(kept), " ".join(kept))
        out[i] = done[key]
    return out
