"""Line deduplication against brute force on thousands of lines: near copies at the threshold, large groups, odd rows."""

import random

from hushlake.llm import lines


def words(line):
    return frozenset(line.lower().replace("\t", " ").replace("\r", " ").split())


def brute(rows):
    """{(doc_id, text): removed} by comparing every line with all earlier ones."""
    each = []
    for d, t in {(d, t) for d, t in rows if t is not None}:
        each += [((d is None, d or 0), t, i, words(x)) for i, x in enumerate(t.split("\n")) if words(x)]
    gone = {(d, t): set() for d, t in rows}
    for d, t, i, w in each:
        for d2, t2, j, v in each:
            if len(w & v) * 9 >= 4 * (len(w) + len(v)) and ((d2, j) < (d, i) if t2 == t or d2 != d else None):
                gone[(None if d[0] else d[1], t)].add(i)
                break
    return {k: sorted(v) for k, v in gone.items()}


def corpus(seed, n_docs, vocabulary, longest):
    rng = random.Random(seed)
    known = [[rng.choice(vocabulary) for _ in range(rng.randint(1, longest))] for _ in range(60)]

    def line():
        if rng.random() < 0.5:
            return [rng.choice(vocabulary) for _ in range(rng.randint(1, longest))]
        w = list(rng.choice(known))
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.25]))):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[i], rng.choice(vocabulary)]])
        if rng.random() < 0.3:
            rng.shuffle(w)
        return w

    sep = lambda: rng.choice([" ", " ", " ", "  ", "\t", "\r"])
    say = lambda: "".join(x + sep() for x in line())
    return [(i, "\n".join(rng.choice(["", " ", say(), say(), say(), say()]) for _ in range(rng.randint(1, 12)))) for i in rng.sample(range(10 * n_docs), n_docs)]


def report(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], None): r["removed"] for r in lines.line_report(df).collect()}


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    rare = common + ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    n = 0
    for seed, (docs, vocabulary, longest) in enumerate([(280, rare, 30), (150, common, 12), (40, rare, 200)]):
        rows = corpus(seed, docs, vocabulary, longest)
        want = {(d, None): gone for (d, _), gone in brute(rows).items()}
        assert report(spark, rows) == want
        n += sum(len(t.split("\n")) for _, t in rows)
    assert n > 2000


def test_ids_that_repeat(spark):
    rare = [f"w{i}" for i in range(400)]
    rows = [(i % 40 if i % 3 else 7, t) for i, t in corpus(9, 150, rare, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], r["removed"]) for r in lines.line_report(df).collect())
    seen, want = [], []
    th = {r["text"]: r["th"] for r in df.selectExpr("text", "xxhash64(text) th").collect()}
    for d, t in sorted(set(rows), key=lambda r: (r[0], th[r[1]])):
        gone = []
        for i, x in enumerate(t.split("\n")):
            if w := words(x):
                if any(len(w & v) * 9 >= 4 * (len(w) + len(v)) for v in seen):
                    gone.append(i)
                seen.append(w)
        want += [(d, len(t.split("\n")), gone)] * rows.count((d, t))
    assert got == sorted(want)


def test_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(40)] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    assert report(spark, rows) == {(d, None): gone for (d, _), gone in brute(rows).items()}


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, ""), (4, None), (5, "b a"), (6, "a b\na  b"), (None, "a b c\nnew line here now"), (None, "new line here now"), (7, "\n\t\n")]
    df = spark.createDataFrame([(*r, 0, 1, 2, 3) for r in rows], "doc_id long, text string, h int, kept int, doc int, at int")
    got = [(r["doc_id"], r["n_lines"], r["n_blank"], r["removed"]) for r in lines.line_report(df).collect()]
    assert sorted(got, key=str)[1:] == sorted([(1, 1, 0, []), (2, 1, 0, [0]), (3, 1, 1, []), (4, 0, 0, []), (5, 1, 0, []), (6, 2, 0, [0, 1]), (7, 3, 3, []), *[g for g in got if g[0] is None]], key=str)[1:]
    nulls = sorted((g for g in got if g[0] is None), key=str)
    assert [g[1] for g in nulls] == [1, 2] and sum(len(g[3]) for g in nulls) == 1  # one of the two equal lines stays
    left = lines.drop_lines(df)
    assert left.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in left.where("doc_id is not null").collect()}
    assert texts == {1: long, 3: "", 4: None, 5: "b a", 7: "\n\t\n"}


def test_pairs_of_near_copies_are_not_made(spark):
    """What is made grows with the keys of a group of near copies, not with its pairs; before, 15,814 pairs were made of 7,800 entries."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(60), rng.randint(3, 5)):
            w[j] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    was = lines.cut
    lines.cut = lambda df: made.append(out := was(df)) or out
    try:
        got = {(r["doc_id"], None): r["removed"] for r in lines.line_report(docs).collect()}
    finally:
        lines.cut = was
    entries = lines._entries(lines._lines(docs), lines._rarity(docs), True).count()
    assert got == {(d, None): gone for (d, _), gone in brute(rows).items()}
    assert made and max(df.count() for df in made) <= entries
