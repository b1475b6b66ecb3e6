import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fairgate.llm.pii_crf import KINDS, all_spans, base_spans, decode, find_pii, fit_crf, luhn, segments_of, train, unit_ends

from .fixtures import docs, edge_rows, empty


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(t):
    """The contract's patterns as they stand."""
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.@.-+12 3(9é\n", max_size=40) | st.lists(st.sampled_from(["1.", "22.", "300.", "0004", "4", "5.6", "7", "..", "a"]), max_size=12).map("".join)
       | st.lists(st.sampled_from(["4111 1111 1111 1111", "4012-8888-8888-1881", " ", "-", "5", "+1 (212) 555-0100"]), max_size=5).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == brute(text)


def sample(spark, n=120):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        card = num(15)
        card += next(str(c) for c in range(10) if luhn(card + str(c)))
        item = (f"{word()}.{num(2)}@{word()}.example.com", f"+1 ({rnd.randrange(200, 999)}) 555-{num(4)}",
                ".".join(str(rnd.randrange(256)) for _ in range(4)), card)[i % 4]
        rows.append((i, " ".join(word() for _ in range(12)) + f" {item} " + " ".join(word() for _ in range(9)), "en", "a"))
    return rows


def test_model_adds_what_the_patterns_miss(spark):
    model = train(docs(spark, sample(spark)), steps=15)
    found = lambda t: [(k, t[a:b]) for k, a, b in all_spans(t, model)]
    assert found("please call (415) 555-2671 today") == [("phone_like", "(415) 555-2671")]
    # two cards in a row are one run for the pattern, which drops it
    two = "so it is 4111111111111111 4012888888881881 and no more"
    assert base_spans(two)["card"] == [] and [k for k, _ in found(two)] == ["card_like", "card_like"]
    assert found("in 2024 we sold 3,500 units of it") == []
    rows = sample(spark, 40)
    for _, text, *_ in rows:
        base = [(k, a, b) for k in KINDS for a, b in brute(text)[k]]
        assert [s for s in all_spans(text, model) if s[0] in KINDS] == base


def test_long_addresses_come_out_whole():
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    addresses = [f"{word()}.{word()}{rnd.choice(['(at)', ' (at) ', '[at]'])}{word()}-{word()}.{word()}.org" for _ in range(120)]
    model = fit_crf([(f"write to {a} or {word()}", [("email", 9, 9 + len(a))]) for a in addresses], steps=30)
    for address in ("jane.doe(at)department-of-physics.university-example.org", "averyveryverylongnameofsomebody.else (at) example.org",
                    "a" * 90 + "(at)" + "b" * 90 + ".org"):
        found = [(k, t[a:b]) for t in (f"write to {address} or not",) for k, a, b in all_spans(t, model)]
        assert found == [("email_like", address)], address


def test_stretches_end_at_white_space():
    from fairgate.llm.pii_crf import REACH, stretches
    text = "x" * 200 + "@" + "y" * 200 + " " + "z" * 300 + " 12 " + "w" * 300
    assert stretches(text) == [(0, 401), (402, 1006)]
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("ab  12@\n") if rnd.random() < 0.1 else rnd.choice("abc ") for _ in range(400))
        got = stretches(t)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        for m in re.finditer("[0-9]{2,}|@", t):
            a, b = next((a, b) for a, b in got if a <= m.start() and m.end() <= b)
            assert a <= max(0, m.start() - REACH) and b >= min(len(t), m.end() + REACH)
            assert (a == 0 or t[a - 1].isspace() or any(a == d for _, d in got)) and (b == len(t) or t[b].isspace())


def test_decoder_finds_the_best_segmentation():
    data = [("aa 1234567 bb", [("phone", 3, 10)]), ("cc 12 dd", []), ("ee 1234-567 f", [("phone", 3, 11)]), ("12 34 g", [])] * 5
    model = fit_crf(data, steps=30)
    for text in ("aa 1234-567 12 7654321 b", "12 34 56"):
        ends = unit_ends(text, 0, len(text))
        segs = list(segments_of(text, ends))
        score = {(i, j, y): model.weights.get((y, "*"), 0) + sum(model.weights.get((y, f), 0) for f in feats)
                 for i, j, feats in segs for y in ("email", "ip", "card", "phone")}

        def best(at, last):
            """Exhaustive search over segmentations of the rest."""
            if at == len(ends) - 1:
                return 0.0, []
            v, path = best(at + 1, "O")
            out = (v, path)
            for (i, j, y), s in score.items():
                if i == at:
                    labels = ["O", "email", "ip", "card", "phone"]
                    v, path = best(j, y)
                    v += s + model.between[labels.index(last), labels.index(y)]
                    if v > out[0]:
                        out = (v, [(y, ends[i], ends[j])] + path)
            return out

        assert decode(model, text, 0, len(text)) == best(0, "O")[1]


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 80_000, "+1" + " " * 200_000, "a@" * 80_000, "1 " * 80_000 + "x"):
        base_spans(t)


def test_edges(spark):
    rows = edge_rows() + [(20, "mail a@b.co now", "en", "a")]
    got = find_pii(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.spans == ("email:5:11" if r.doc_id == 20 else "")
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.n_email == int(r.doc_id == 20)
    assert train(docs(spark, edge_rows())) is None
    assert find_pii(empty(spark)).count() == 0
