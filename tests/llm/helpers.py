"""Small corpora and plain forms of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

#: Null and empty texts, ties, copies up to white space, near copies, long texts, other scripts.
BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None,
    "",
    " \t\n\x0b ",
    "one",
    "One",
    "a b c d",
    "A b\tc  d",
    BASE,
    BASE + " ",
    BASE.replace("w60 ", "other "),
    BASE.replace("w60 ", "other ").replace("w20 ", "word "),
    " ".join(f"v{i}" for i in range(80)),
    "Größe ça va, 東京 Straße. J̌ İx it's don't, é. x y",
    "long " * 30000 + "end.",
    "x" * 50000,
    "one two three four five " * 30 + "\nsix\nsix\nsix",
    "#*$ %&| <> # |" * 20,
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, run int, row int, size int, part int, key int"


def documents(spark, texts=TEXTS, empty=False, repeat=False):
    """Rows of ``documents`` with extra columns whose names clash with those the operators use inside."""
    rows = [
        (i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", 1, 2, 3, 4, None)
        for i, t in enumerate(texts)
    ]
    rows = [] if empty else rows + rows[5:9] * repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    found = words((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def near_components(texts):
    """Number of shingles and smallest reachable id of each text, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    shared = {}
    for i, s in sets.items():
        for g in s:
            shared.setdefault(g, []).append(i)
    pairs = {(a, b) for group in shared.values() for n, a in enumerate(group) for b in group[n + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}
