"""Small tables with every awkward row, and plain Python versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", start string, gone string, slot string, n string, score string, kept string"


def texts(seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, line = sentence(70), sentence(9)
    base = sentence(300)
    near = base.split()
    near[150] = "changed"
    out: list[str | None] = [None, "", " \t\n ", "one", "Two words", "a b c d e"]
    out += [base, base, " ".join(near), base.upper()]
    out += [sentence(40) + "\n" + shared + "\n" + sentence(40), shared, sentence(30) + " " + shared]
    block = "\n".join([line, sentence(8), sentence(7), sentence(9)])
    out += [sentence(12) + "\n" + block + "\n" + sentence(5), block + "\n\n" + sentence(6), block]
    out += ["\n".join(["same line here"] * 6), sentence(5000), "é漢 ñ x y #*$ a|b <>\r\n!", "idiot " + sentence(20)]
    out += [sentence(r.randint(1, 120)) for _ in range(20)]
    return out


def table(spark, rows=None, extra: bool = False, first_id: int = 0):
    """The texts as documents; with ``extra`` further columns whose names clash with inner ones."""
    every = texts() if rows is None else rows
    data = [(first_id + i, t, ["en", "fr", None][i % 3], f"s{i % 4}", len(t) if t is not None else None) for i, t in enumerate(every)]
    if not extra:
        return spark.createDataFrame(data, SCHEMA)
    return spark.createDataFrame([(*d, "x", "y", "z", "n", "s", "k") for d in data], SCHEMA + EXTRA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest id reachable) by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def substring_kept(texts: dict[int, str | None], width: int = 50) -> dict[int, list[bytes]]:
    first: dict[tuple, int] = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i in texts:
        w = words(texts[i])
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def lines_kept(texts: dict[int, str | None], min_run: int = 1) -> dict[int, str | None]:
    """Delete each line of a run of lines that has been seen before, in order of ids and places."""
    seen: set[tuple[str, ...]] = set()
    out: dict[int, str | None] = {}
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        bare = [x.strip(" \t\n\v\f\r") for x in lines]
        at = [k for k, x in enumerate(bare) if x]
        gone: set[int] = set()
        for p in range(len(at) - min_run + 1):
            run = tuple(bare[k] for k in at[p : p + min_run])
            if run in seen:
                gone.update(at[p : p + min_run])
            seen.add(run)
        out[i] = None if texts[i] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out
