"""Splitting, packing, leakage, page noise and subjects on small inputs."""

import random
import re

import numpy as np
import pytest
from lodeweave.llm import leakage, ocr, packing, splitting, subjects

CHUNK = "id bigint, document_id bigint, text string, line_start int, line_end int, page int"


def test_pieces_cover_the_text_within_the_limit():
    rng = random.Random(1)
    for text in ["x" * 20_000, "", "a", "\n" * 9_000, " ".join("w" * rng.randrange(1, 90) for _ in range(900)), "\n".join("l" * rng.randrange(0, 300) for _ in range(200)), "é" * 6_001, "One. " * 3_000]:
        spans = splitting.cut(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(text) <= 6000 and len(spans) == 1 or all(0 < e - s <= 5800 for s, e in spans)


def test_cuts_fall_on_blank_lines():
    text = "\n\n".join("\n".join("word " * 8 for _ in range(30)) for _ in range(10))
    for s, _ in splitting.cut(text)[1:]:
        assert text[s - 2 : s] == "\n\n"


def test_pieces_carry_lines_and_overlap(spark):
    text = "\n".join(f"{i}: {'y' * 100}" for i in range(10, 110))
    rows = [(1, 5, text, 10, 109, None), (1, 5, text, 10, 109, None), (2, 5, "short", 1, 1, 3), (3, None, "z" * 7000, None, None, 4), (None, 1, text, 1, 1, 1), (4, 1, None, 1, 1, 1)]
    got = splitting.split_oversized(spark.createDataFrame(rows, CHUNK)).orderBy("id", "piece").collect()
    assert {r.id for r in got} == {1, 3}
    for a, b in zip(got, got[1:]):
        if a.id == b.id:
            assert b.overlap == 200 and a.text.endswith(b.text[:200]) and len(b.text) <= 6000
    one = [r for r in got if r.id == 1]
    assert one[0].line_start == 10 and one[-1].line_end == 109
    for r in one:
        assert f"{r.line_end}: " in r.text and (f"{r.line_start}: " in r.text or r.overlap)
    assert {(r.line_start, r.page) for r in got if r.id == 3} == {(None, 4)}
    assert splitting.split_oversized(spark.createDataFrame(rows, CHUNK), keep_small=True).select("id").distinct().count() == 3
    assert splitting.split_oversized(spark.createDataFrame([], CHUNK)).count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    h = np.zeros(33, np.int64)
    h[1:] = rng.integers(0, 9, 32)

    def cost(bounds):
        total = 0.0
        for n in range(1, 33):
            u = min(b for b in bounds if b >= n)
            total += h[n] * (32 / (32 // u) - n)
        return total

    from itertools import combinations

    best = min(cost([*c, 32]) for k in range(3) for c in combinations(range(4, 32, 4), k))
    assert cost(packing.bucket_bounds(h, 3, 4)) == pytest.approx(best)


def test_containers(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(rng.choice([3, 50, 5000, rng.randrange(1, 900)])))) for i in range(120)] + [(500, ""), (501, None), (0, "word")]
    df = spark.createDataFrame(rows[:-1] + [rows[0]], "doc_id bigint, text string")
    got = packing.packed(df).collect()
    counter = packing.TokenCounter(packing.VOCABULARY)
    want = {i: counter.count(t) for i, t in rows[:-1] if t}
    have: dict = {}
    boxes: dict = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.tokens
        boxes[r.container] = boxes.get(r.container, 0) + r.tokens
    assert have == want and max(boxes.values()) <= 2048
    parts = {d: sum(r.doc_id == d for r in got) for d in want}
    assert all(parts[d] == -(-n // 2048) for d, n in want.items())
    assert len(boxes) <= -(-sum(want.values()) // 2048) + 3
    assert packing.packed(df.limit(0)).count() == 0


def test_token_counts_are_the_encodings():
    counter = packing.TokenCounter(packing.VOCABULARY)
    for text in ["", "Hello  world\n\n it's 12 é ünï 漢字", "a" * 1000, "<|endoftext|>"]:
        assert counter.count(text) == len(counter.encoding.encode_ordinary(text))


def brute_leaks(docs, items, run=13):
    words = lambda s: re.findall(r"[a-z0-9_]+", s.lower())
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    inner = {i: grams(words(t)) for i, t in items if t}
    return {(d, i) for d, t in docs if t for i, g in inner.items() if g & grams(words(t))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["page", "table", "the", "of", f"w{rng.randrange(400)}"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 60)))) for i in range(30)] + [(90, None), (91, "short one")]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.7:
            src = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(src))
            part = src[a : a + rng.randrange(8, 30)]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "changed"
            k = rng.randrange(len(w) + 1)
            w[k:k] = part
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(200, None), (201, "")]
    got = [tuple(r) for r in leakage.leaked(spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)


def test_edited_passages_are_regions(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from afar tonight"
    docs = [(1, item.replace("jumps", "jumpd")), (2, item.replace("o", "xx")), (3, item)]
    got = {r.doc_id: (r.edits, r.run_words) for r in leakage.leaked_regions(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 3} and got[1] == (1, 12) and got[3] == (0, 17)


PAGES = "chunk_id bigint, source_path string, source_type string, page int, text string"


def test_page_noise(spark):
    filler = "\n".join("the mapping of the register is described in the following chapter" for _ in range(8))
    page = lambda n, body: f"Rev 1.0 \u2014 Some Long Title\n{body}\n- {n} -"
    rows = [
        (1, "a", "pdf", 7, page(7, f"Some Long Title\n\n{filler}\nthe map-\nping of the low-\nlatency register\nthe regis\u00ac")),
        (2, "a", "PDF", 8, page(8, f"ter of the low-latency mapping\n{filler}\nthe rnapping of the rcgister")),
        (2, "a", "PDF", 8, page(8, f"ter of the low-latency mapping\n{filler}\nthe rnapping of the rcgister")),
        (3, "a", "doc", 9, "the map-\nping"),
        (4, None, "pdf", None, None),
        (5, None, "pdf", None, ""),
    ]
    got = {tuple(r) for r in ocr.noise_cases(spark.createDataFrame(rows, PAGES)).collect()}
    first, second = 1 + 2 + 8, 2 + 8
    want = {(1, 1, "header"), (2, 1, "header"), (1, first + 4, "hyphen"), (1, first + 1, "hyphen")}
    assert want <= got, got
    assert (1, first + 2, "hyphen") not in got
    assert {x for x in got if x[2] == "misread"} == {(2, second + 1, "misread")}
    assert {x[:2] for x in got if x[2] == "pageno"} == {(1, 16), (2, 12)}
    assert not any(x[0] in (3, 4, 5) for x in got)
    text = " ".join(r.text for r in ocr.repaired(spark.createDataFrame(rows, PAGES)).orderBy("paragraph").collect() if r.text)
    assert "the mapping of the low-latency" in text
    assert "Rev 1.0" not in text and "the register of the low-latency mapping" in text and "rnapping" not in text


def test_every_form_of_a_skeleton_can_be_meant(spark):
    lines = [x for k, w in enumerate(("tile", "tire", "fire", "trie", "tric", "flic")) for x in [f"one {w} number{'abcdef'[k]} stands"] * 9]
    lines += ["please open the file again"] * 5 + ["please open the fiie again"] + ["nothing more stands on here"] * 4
    pages = spark.createDataFrame([(1, "a", "pdf", 1, "\n".join(lines))], PAGES)
    assert [tuple(r) for r in ocr.noise_cases(pages).where("noise = 'misread'").collect()] == [(1, 60, "misread")]
    assert {(r.word, r.form) for r in ocr.noise(pages)["misread"].collect()} == {("fiie", "file")}


def test_page_noise_of_nothing(spark):
    assert ocr.noise_cases(spark.createDataFrame([], PAGES)).count() == 0


def test_subjects_held_out(spark):
    rng = random.Random(5)
    terms = {s: [f"{s}{a}{b}" for a in "abcdefgh" for b in ("xa", "yo")] for s in ("mem", "net", "law")}
    docs, truth = [], {}
    for d in range(240):
        subs = rng.sample(sorted(terms), 1 if rng.random() < 0.7 else 2)
        truth[d] = set(subs)
        lines = [f"The {rng.choice(terms[subs[k % len(subs)]])} {rng.choice(terms[subs[k % len(subs)]])} of this section." for k in range(12)]
        docs.append((d, " ".join(lines)))
    labels = [(d, s) for d in range(0, 240, 6) for s in truth[d]]
    df = spark.createDataFrame(docs + [docs[0], (900, None), (901, "12 34")], "doc_id bigint, text string")
    got: dict = {}
    for r in subjects.assigned(df, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert 900 not in got and len(got[901]) == 1 and all(1 <= len(s) <= 3 for s in got.values())
    held_out = [d for d in range(240) if d % 6]
    assert sum(got[d] == truth[d] for d in held_out) >= 0.9 * len(held_out)


def test_subjects_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.assigned(docs, labels).count() == 0


def test_words_and_ends_of_sentences():
    plain = re.compile(r"(?<!\w)[a-zà-öø-ÿœß]{3,}(?!\w)|[.!?](?=\s)|\n")
    rng = random.Random(9)
    for signs in ("abC_7.!? \n\t\r\x00\x1c\x0b()", "abÉœß\xd7İ\u0301ªж_7.!?\n\x85\xa0 ’"):
        for _ in range(500):
            text = "".join(rng.choices(signs, k=60)).replace("a", "abc")
            want = ["\x00" if t in ".!?\n" else t for t in plain.findall(text.lower())]
            for ends in (True, False):
                got = [t for t in subjects.tokens(text, ends) if t == "\x00" or subjects._WORD.fullmatch(t)]
                assert got == [t for t in want if ends or t != "\x00"], text


def test_terms_are_counted_once_for_each_document(spark, monkeypatch):
    texts = ["Page table of the page table. Ends x1", "the page\nÜber page", "", "page"]
    want = {"page": 3, "table": 1, "the": 2, "ends": 1, "über": 1, "page table": 1, "table the": 1, "the page": 2, "table page": 0, "table ends": 1, "page über": 1, "über page": 1}
    monkeypatch.setattr(subjects, "REMEMBERED", 2)
    got = {r.term: r.n for r in subjects.term_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_vectors_descend_to_the_nearer_child():
    rng = np.random.default_rng(6)
    tree = subjects.Tree(rng.random((7, 20)))
    tree.children = {0: (1, 2), 1: (3, 4), 4: (5, 6)}
    rows = [np.sort(rng.choice(20, k, replace=False)) for k in (3, 0, 7, 1, 20)]
    vals = [rng.random(len(r)) for r in rows]
    want = []
    for r, v in zip(rows, vals):
        k = 0
        while k in tree.children:
            a, b = tree.children[k]
            k = b if tree.centres[b, r] @ v > tree.centres[a, r] @ v else a
        want.append(k)
    batch = subjects.pa.RecordBatch.from_arrays([subjects.pa.array([r.astype("<u2").tobytes() for r in rows]), subjects.pa.array([v.astype("<f2").tobytes() for v in vals])], names=["vec_ids", "vec"])
    ids, _, ends = subjects._flat(batch.slice(1, 3))
    assert ids.tolist() == np.concatenate(rows[1:4]).tolist() and ends.tolist() == [0, 7, 8]
    assert tree.descend(np.concatenate(rows), np.concatenate(vals), np.cumsum([len(r) for r in rows])).tolist() == want


def test_bounds_decide_the_batches():
    sizes = np.array(random.Random(8).choices(range(5, 1900), k=3000))
    histogram = np.bincount(sizes, minlength=2049)
    results = []
    for bounds in (packing.bucket_bounds(histogram), [100, 700, 2048]):
        own = np.array(bounds)[np.searchsorted(bounds, sizes)]
        box, batch = packing.fill(sizes, bounds, 2048)
        assert np.bincount(box, weights=sizes).max() <= 2048
        for b in np.unique(box)[:200]:
            here = box == b
            assert len(set(batch[here])) == 1 and (own[here] <= batch[here]).all()
            if b < box.max() - 1:  # a batch has as many items of its own bucket as the padded sizes allow, but for a bucket's last
                assert (own[here] == batch[here]).sum() >= min(2048 // batch[here][0], 1)
        results.append(box)
        assert 1 - sizes.sum() / (2048 * (box.max() + 1)) < 0.05
    assert len({tuple(np.bincount(r)) for r in results}) == 2


@pytest.mark.parametrize("sf,group", [("sf0.01", 50_000), ("sf0.1", 2_000)])
def test_little_space_is_unused(spark, sf, group):
    from lodeweave.session import table

    row = packing.packing_summary(packing.packed(table(spark, f"/root/testdata/{sf}", "documents"), group=group)).where("bucket is null").first()
    assert row.unused < 0.01 and 0 < row.completing < row["items"]


def planted(rng, edits):
    """A document with a passage of 13 words of an item and so many edited letters in it, and the item."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    item = [word() for _ in range(60)]
    a = rng.randrange(0, 47)
    passage = list(" ".join(item[a : a + 13]))
    for k in rng.sample(range(len(passage)), edits):
        passage[k] = rng.choice("zyx") if passage[k] != " " else " "
    return " ".join([word() for _ in range(50)] + ["".join(passage)] + [word() for _ in range(50)]), " ".join(item)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_planted_passages_are_found(edits):
    rng = random.Random(20 + edits)
    found = 0
    for _ in range(200):
        doc, item = planted(rng, edits)
        rows = leakage.Index([(1, item)]).regions(leakage.normal(doc))
        found += any(r[5] <= edits for r in rows)
        assert all(0 <= r[5] <= leakage.EDITS for r in rows)
    assert found == 200


def test_long_leaks_with_many_edits_are_found():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    item = [word() for _ in range(60)]
    doc = [w if k % 10 else "zz" + w for k, w in enumerate(item)]
    rows = leakage.Index([(1, " ".join(item))]).regions(leakage.normal(" ".join(doc)))
    assert rows and min(r[5] for r in rows) <= 2 and max(r[6] for r in rows) == 9
    assert leakage.Index([(1, " ".join(item))]).regions(leakage.normal(" ".join(word() for _ in range(500)))) == []
    repeated = " ".join(["a b"] * 40)
    assert max(r[6] for r in leakage.Index([(1, repeated)]).regions(leakage.normal(repeated))) >= 13
