import random

from fairgate.llm.line_dedup import line_dedup, smallest_blocks

from .fixtures import docs, edge_rows, empty


def blocks_of(lines, min_words=3, passage_words=50):
    """All (first line, last line) of blocks with no smaller block at the same start or the same end."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    enough = lambda some: (sum(len(lines[i].split()) for i in some) >= passage_words
                           or len(some) > 1 and any(len(lines[i].split()) >= min_words for i in some))
    out = set()
    for p in range(len(full)):
        out |= {next(((full[p], full[k]) for k in range(p, len(full)) if enough(full[p:k + 1])), None),
                next(((full[k], full[p]) for k in range(p, -1, -1) if enough(full[k:p + 1])), None)}
    return out - {None}


def brute(rows):
    """Every block of every text by its bytes: the first stays, the others go with the blank lines that it has too."""
    texts = {(doc_id, text): text.encode().split(b"\n") for doc_id, text, *_ in rows if text is not None}
    places = {}
    for (doc_id, text), lines in texts.items():
        for i, j in blocks_of(lines):
            places.setdefault(b"\n".join(lines[i:j + 1]), []).append(((doc_id is None, 0 if doc_id is None else doc_id, text, i), (doc_id, text), i, j))

    def blank_run(lines, at, step):
        out = []
        while 0 <= at + step < len(lines) and not lines[at + step].strip():
            at += step
            out.append(lines[at])
        return out

    def equal(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    gone = {key: set() for key in texts}
    for held in places.values():
        _, key0, i0, j0 = min(held)
        for _, key, i, j in held:
            if (key, i) != (key0, i0):
                up = equal(blank_run(texts[key], i, -1), blank_run(texts[key0], i0, -1))
                down = equal(blank_run(texts[key], j, 1), blank_run(texts[key0], j0, 1))
                gone[key] |= set(range(i - up, j + down + 1))
    return {key: b"\n".join(x for i, x in enumerate(lines) if i not in gone[key]).decode() for key, lines in texts.items()}


def planted(n=200):
    rnd = random.Random(1)
    words = [f"v{i}" for i in range(3000)]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [[line(11) for _ in range(6)], [line(60)], [line(30) for _ in range(2)]]
    short = line(7)
    rows = []
    for i in range(n):
        lines = [line(rnd.randrange(3, 15)) for _ in range(rnd.randrange(2, 12))]
        if i % 3 == 0:
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = passages[(i // 3) % 3]
        elif i % 3 == 1:
            lines.insert(rnd.randrange(len(lines) + 1), short)     # one short line that many share
        rows.append((i, "\n".join(lines), "en", "a"))
    return rows, passages


def test_equals_the_rule_on_lists(spark):
    rows, _ = planted()
    expected = brute(rows)
    for r in line_dedup(docs(spark, rows)).collect():
        assert r.text == expected[r.doc_id, rows[r.doc_id][1]]


def test_short_odd_and_blank_lines_equal_the_rule(spark):
    rnd = random.Random(11)
    pool = [["a", "b"], ["one two three"], ["x y", "", "z"], [" "], ["", ""], ["c d e f"], ["g"], [" ".join(f"m{i}" for i in range(52))]]
    rows = []
    for i in range(150):
        lines = [x for _ in range(rnd.randrange(7)) for x in (rnd.choice(pool) if rnd.random() < 0.8 else [f"own {i} {rnd.random()}"])]
        rows.append((i if i % 10 else None, "\n".join(lines), "en", "a"))
    expected = brute(rows)
    got = sorted(((r.doc_id, r.text) for r in line_dedup(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i, expected[i, t]) for i, t, *_ in rows), key=str)


def test_planted_passages_go_and_clean_texts_stay(spark):
    rows, passages = planted()
    got = {r.doc_id: r for r in line_dedup(docs(spark, rows)).collect()}
    assert all(got[i].text == rows[i][1] and got[i].lines_removed == 0 for i in got if i % 3)
    for k, passage in enumerate(passages):
        holders = [i for i in got if i % 3 == 0 and (i // 3) % 3 == k]
        assert sum(all(x in got[i].text.split("\n") for x in passage) for i in holders) <= 1 + len(holders) // 10


def test_blocks_do_not_depend_on_what_stands_before():
    rnd = random.Random(3)
    block = [f"line {rnd.random()} of the block".encode() for _ in range(12)]
    found = lambda lead: {(i - len(lead), j - len(lead)) for i, j, *_ in smallest_blocks(lead + block, 3, 50) if i >= len(lead)}
    assert found([b"x"]) == found([b"some", b"", b"other", b"lead"]) == found([]) and len(found([])) == 11


def test_exact_copies_with_one_in_a_third_of_rows(spark):
    text = "one line of it\nanother line of it\nthe third line of it\nthe last line of it all"
    rows = [(i, text if i % 3 == 0 else f"own line {i}\nand one more own line {i} here", "en", "a") for i in range(150)]
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, rows)).collect()}
    assert got[0] == text and all(got[i] == "" for i in range(3, 150, 3)) and all(got[i] == rows[i][1] for i in range(150) if i % 3)


def test_edges(spark):
    rows = edge_rows()
    df = docs(spark, rows, extra=True)
    out = line_dedup(df)
    assert out.columns == [*df.columns, "lines_removed"] and out.count() == len(rows)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    expected = brute(rows)
    assert got == sorted(((i, None if t is None else expected[i, t]) for i, t, *_ in rows), key=str)
    assert line_dedup(empty(spark)).count() == 0


def holders_with_lines(got, holders, passage):
    """The holders that keep any of the passage's lines that are not blank."""
    lines = {x for x in passage if x.strip()}
    return [i for i in holders if lines & set(got[i].split("\n"))]


def surrounded(rnd, passages, n):
    """n documents of own lines, with a passage in every second one at an odd place."""
    own = lambda i: [f"own {i} {k} " + " ".join(f"x{rnd.random()}" for _ in range(rnd.randrange(1, 30))) for k in range(rnd.randrange(1, 8))]
    rows = []
    for i in range(n):
        lines = own(i)
        if i % 2:
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = passages[i // 2 % len(passages)]
        rows.append((i, "\n".join(lines), "en", "a"))
    return rows


def check_all_gone(spark, rows, passages):
    """The first holder of each passage keeps it whole, no other keeps a line of it, own lines all stay."""
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, rows)).collect()}
    for k, passage in enumerate(passages):
        holders = [i for i in got if i % 2 and i // 2 % len(passages) == k]
        first = min(holders)
        assert got[first] == rows[first][1]
        assert holders_with_lines(got, [i for i in holders if i != first], passage) == []
    planted_lines = {x for p in passages for x in p}
    for i, text, *_ in rows:
        own = [x for x in text.split("\n") if x not in planted_lines]
        assert [x for x in got[i].split("\n") if x.strip() and x not in planted_lines] == [x for x in own if x.strip()]


def test_passages_with_blank_lines_between_go_whole(spark):
    rnd = random.Random(7)
    line = lambda k: " ".join(f"v{rnd.randrange(9000)}" for _ in range(k))
    passages = [[line(40), "", line(40), "", line(40)], [line(12), "", line(9), "", "", line(14), "", line(15), " ", line(8)]]
    check_all_gone(spark, surrounded(rnd, passages, 60), passages)


def test_an_odd_first_holder_saves_no_passage(spark):
    rnd = random.Random(8)
    line = lambda k: " ".join(f"v{rnd.randrange(9000)}" for _ in range(k))
    a, b = line(30), line(30)
    rows = [(0, f"{a}\nown line of the first one\n{b}", "en", "a")]
    rows += [(i, f"own line {i} before it\n{a}\n{b}\nown line {i} behind it", "en", "a") for i in range(1, 20)]
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1] == rows[1][1]
    assert all(got[i] == f"own line {i} before it\nown line {i} behind it" for i in range(2, 20))


def test_passages_of_any_line_length_go_whole(spark):
    rnd = random.Random(9)
    line = lambda k: " ".join(f"v{rnd.randrange(9000)}" for _ in range(k))
    verse = [[line(rnd.randrange(1, 3)) for _ in range(40)] for _ in range(4)]
    short = [[line(rnd.randrange(13, 16)) for _ in range(4)] for _ in range(60)]
    ends = [[line(20), line(1), line(1), line(2), line(1)], [line(1), line(2), line(1), line(3)]]
    assert all(sum(len(x.split()) for x in p) >= 50 for p in verse)
    check_all_gone(spark, surrounded(rnd, verse + short + ends, 1000), verse + short + ends)
