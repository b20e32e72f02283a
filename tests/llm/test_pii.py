import hashlib
import random
import re
import tracemalloc

import odd

from conftest import SMALL
from tilepulse.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = [
    "a", "b.c", "@", "x@y.z", "@@", ".", "-", "+", "1", "22", "255", "256", "001", " ", "  ", "(",
    ")", "1.2.3.4", "4111 1111 1111 1111", "4539578763621486", "+1 (555) 123-4567", "é", "\n",
    "jo.e%1@mail.example.com", "+", "0", "-", "12345678",
]


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def test_patterns_match_as_written_plainly():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 10)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


def test_field_on_held_out_windows():
    weights, rng = pii.trained(), random.Random(1234)
    right = found = there = 0
    for _ in range(600):
        text, gold = pii.example(rng)
        got = set(pii.best_cut(text, 0, len(text), weights))
        right, found, there = right + len(got & set(gold)), found + len(got), there + len(gold)
    assert right / found > 0.95 and right / there > 0.95


def test_best_cut_equals_trying_all():
    weights, rng = pii.trained(), random.Random(8)
    for _ in range(40):
        text, _ = pii.example(rng)
        window = pii.Window(text[:30], 0, min(30, len(text)))
        scores = (window.rows @ weights).max(axis=1) if len(window.rows) else []

        def best_from(i):
            if i == window.n:
                return 0.0
            options = [best_from(i + 1)]
            options += [scores[s] + best_from(b) for s, (a, b) in enumerate(window.spans) if a == i]
            return max(options)

        if window.n > 12:
            continue
        at = {(window.edges[a], window.edges[b]): s for s, (a, b) in enumerate(window.spans)}
        got = sum(scores[at[a, b]] for _, a, b in pii.best_cut(text[:30], 0, min(30, len(text)), weights))
        assert abs(got - best_from(0)) < 1e-9


def test_added_spans_leave_base_spans_alone():
    weights = pii.trained()
    text = "mail joe (at) host.example.com or jo@x.org, call (678) 555-5272 or +1 (843) 555-7672"
    base, spans = pii.find(text, weights)
    assert set(base) <= set(spans) and len(spans) > len(base)
    added = [s for s in spans if s not in base]
    assert all(e <= a or b <= s for _, s, e in added for _, a, b in base)
    assert pii.redact(text, spans).count("<PHONE>") == 2


def test_spelt_out_addresses_are_found_in_any_case():
    weights = pii.trained()
    for name in ("john", "mary.jones", "a_b"):
        for at in (" [AT] ", " (At) ", "(AT)", " [at] ", " at ", " AT "):
            for dot in (" [DOT] ", " dot ", " Dot "):
                for form in (f"{name}{at}example{dot}com", f"{name}{at}example{dot}org".upper()):
                    text = f"please write, {form}, or come by"
                    assert pii.redact(text, pii.find(text, weights)[1]) == "please write, <EMAIL>, or come by"


def test_at_and_dot_in_prose_are_left_alone():
    weights = pii.trained()
    for text in ("look at the dot on the map", "he stood at home", "At this dot we stop", "aim at a dot (at best)"):
        assert pii.find(text, weights) == ([], [])


def test_anchors_are_linear():
    for text in ("at." * 100_000, "at " * 100_000, "at dot " * 50_000, "(at" * 100_000):
        sum(1 for _ in pii.ANCHOR.finditer(text))


def test_clean_text_is_left_alone():
    weights = pii.trained()
    for text in ("", "Chapter 12, page 3.", "CC BY-NC 4.0.", "in 1999-2005 and on 2024-05-06 at 10:20:30"):
        assert pii.find(text, weights) == ([], [])


def test_overlapping_spans_are_replaced_once():
    assert pii.redact("abcdefgh", [(0, 1, 4), (2, 3, 6), (3, 7, 8)]) == "a<EMAIL>g<PHONE>"


def test_odd_documents(spark):
    found = pii.personal_data(odd.documents(spark))
    assert found.count() == len(odd.rows()) and pii.personal_data(odd.none(spark)).count() == 0
    clean = pii.redacted(odd.documents(spark))
    assert clean.columns == odd.documents(spark).columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(r[1] or "" for r in odd.rows())


def test_query_7(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_personal_data"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(r.spans.split(","))


def number_table(rng, lines):
    cell = lambda: f"{rng.randrange(10 ** rng.randint(1, 6))}{rng.choice(['', '.5', '-7', '%'])}"
    return "\n".join("\t".join(cell() for _ in range(8)) for _ in range(lines))


def test_cut_does_not_depend_on_blocks(monkeypatch):
    weights, rng = pii.trained(), random.Random(12)
    texts = [number_table(rng, 6), "".join(pii.example(rng)[0] for _ in range(20))]
    texts += ["".join(rng.choices(PIECES, k=60)) for _ in range(20)]
    whole = [pii.best_cut(t, 0, len(t), weights) for t in texts]
    assert sum(map(len, whole)) > 10
    monkeypatch.setattr(pii, "BLOCK", 25)
    assert [pii.best_cut(t, 0, len(t), weights) for t in texts] == whole


def test_memory_of_a_digit_dense_text_is_bounded():
    weights, rng = pii.trained(), random.Random(13)
    peaks = []
    for lines in (100, 300):
        text = number_table(rng, lines)
        tracemalloc.start()
        pii.find(text, weights)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]
