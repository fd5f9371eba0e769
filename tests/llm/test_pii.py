from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from dossierlake.llm import pii

PLAIN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in p.finditer(text) if fits(kind, m.group()))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab.@-+0123456789 ()é%_"), max_size=60))
def test_base_equals_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_known_cases():
    for text in ("@foo.bar@baz.com", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111-1111 1111", "+49 (30) 1234-567.", "0001.02.3.4", "x@y"):
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for run in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "+1" + "(" * 200_000, "1." * 100_000):
        pii.base_spans(run)


def docs(spark):
    rows = [(i, f"filler{i} text{i} holder zanthor mails zan@thor.org about case{i} and words{i} the end") for i in range(4)]
    rows += [(10 + i, f"holder of the text number{i} and the end about mails") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_are_added(spark):
    found = {r["doc_id"]: r for r in pii.find_spans(docs(spark)).collect()}
    text = "filler0 text0 holder zanthor mails zan@thor.org about case0 and words0 the end"
    spans = {text[s["start"] : s["end"]]: s["kind"] for s in found[0]["spans"]}
    assert spans["zan@thor.org"] == 0 and spans["zanthor"] == 4
    assert "holder" not in spans and "case0" not in spans  # common words, and words met once
    assert [s["kind"] for s in found[0]["base"]] == [0]
    assert all(not r["spans"] for i, r in found.items() if i >= 10)


def test_sanitise(spark):
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs(spark)).collect()}
    assert "zanthor" not in out[0] and "[EMAIL]" in out[0] and "holder" in out[0]
    assert out[10].startswith("holder of the text")


def test_disclosed_terms_are_found_in_all_texts(spark):
    far = "é Zanthor " + "of the text " * 300 + "zanthor"
    more = spark.createDataFrame([(50, far), (51, "zan@thor.org " + "and the " * 300 + "zanthor"), (52, "xzanthor zanthors")], "doc_id long, text string")
    both = docs(spark).unionByName(more).repartition(3)
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_spans(both).collect()}
    assert found[50] == [(2, 4, 9), (len(far) - 7, 4, len(far))]
    assert found[51] == [(0, 0, 12), (13 + 8 * 300, 4, 20 + 8 * 300)]
    assert found[52] == [] and all(not found[i] for i in range(10, 50))
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(both).collect()}
    assert not any("zanthor" in out[i].lower() for i in (0, 50, 51))


def test_words_across_the_edge_count_whole():
    run = "é" * 500
    for text in (f"a {run} zan@thor.org", f"zan@thor.org {run} a", f"{run}4111111111111111"):
        spans = pii.base_spans(text)
        terms = {t for _, t, *_ in pii.near_terms(text, spans)[1]}
        assert int(pii._hash_texts([run]).view("int64")[0]) in terms
    assert [s for *_, s in pii.near_terms(text, spans)[1]] == [[(0, 500)]]  # cut off by the entity


def test_repeats_in_one_document_and_fixed_surroundings_disclose(spark):
    near = "about zanthor mails zan@thor.org from text"
    others = [(10 + i, f"holder of the text number{i} from the end about mails") for i in range(40)]
    for rows in ([(0, f"{near} {'and the ' * 20}in zanthor of zan@thor.org")], [(i, near) for i in range(6)]):
        found = pii.find_spans(spark.createDataFrame(rows + others, "doc_id long, text string")).where("doc_id < 10").collect()
        assert all((6, 4, 13) in [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in found) and len(found) == len(rows)
    once = spark.createDataFrame([(0, near), *others], "doc_id long, text string")
    assert [s["kind"] for s in pii.find_spans(once).where("doc_id = 0").first()["spans"]] == [0]
    assert 4 in [s["kind"] for s in pii.find_spans(once, support=1).where("doc_id = 0").first()["spans"]]


def test_strange_rows(spark, strange, empty):
    assert pii.find_spans(strange).count() == strange.count()
    assert pii.find_spans(empty).collect() == []


ALL_KINDS = "mail a@b.cd or e-f@g.hi, host 10.0.0.255, card 4111 1111 1111 1111, call +49 30 1234567."


def test_counts_of_each_kind(spark, tmp_path):
    rows = [(1, ALL_KINDS), (2, "mail a@b.cd"), (3, None), (4, "host 1.2.3.4 and 1.2.3.5")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r["doc_id"]: [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] for r in pii.op3_pii(spark, f"file://{tmp_path}").collect()}
    assert found == {1: [2, 1, 1, 1], 2: [1, 0, 0, 0], 3: [0, 0, 0, 0], 4: [0, 2, 0, 0]}


def listed(spans):
    return ",".join(f"{(*(k for k, _ in PLAIN), 'term')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def brute(rows, generalise=0.6, support=2):
    """Shares counted term by term over all texts: the spans of each row."""
    word = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = [plain(t or "") for _, t in rows]
    n_term, n_entity, n_both, times = Counter(), Counter(), Counter(), Counter()
    cut = []
    for (_, t), spans in zip(rows, base, strict=True):
        t = t or ""
        n_term.update({m.group().translate(low) for m in word.finditer(t)})
        pairs, entities, pieces = Counter(), set(), set()
        for a, k, b in spans:
            value = re.sub("[^0-9]", "", t[a:b]) if k > 1 else t[a:b].lower()
            entities.add((k, value))
            before = [(m.start(), min(m.end(), a)) for m in word.finditer(t) if m.start() < a][-10:]
            after = [(max(m.start(), b), m.end()) for m in word.finditer(t) if m.end() > b][:10]
            near = [(x, y) for x, y in before + after if not any(s < y and x < e for s, _, e in spans)]
            pairs.update({((k, value), t[x:y].translate(low)) for x, y in near})
            whole = {m.span() for m in word.finditer(t)}
            pieces |= {(x, 4, y) for x, y in near if (x, y) not in whole}
        n_entity.update(entities)
        n_both.update(pairs.keys())
        times.update(pairs)
        cut.append(pieces)
    total, disclosed = len(rows), set()
    for (e, term), n in n_both.items():
        if times[e, term] >= support and n_term[term] and total > n_entity[e]:
            if math.log2(total * n / (n_term[term] * n_entity[e])) / math.log2(total / n_entity[e]) >= generalise:
                disclosed.add(term)
    out = []
    for (_, t), spans, pieces in zip(rows, base, cut, strict=True):
        t = t or ""
        terms = {(m.start(), 4, m.end()) for m in word.finditer(t)} | pieces
        terms = {x for x in terms if t[x[0] : x[2]].translate(low) in disclosed and not any(s < x[2] and x[0] < e for s, _, e in spans)}
        out.append(listed({*spans, *terms}))
    return out


def test_spans_equal_brute_force(spark):
    r = random.Random(3)
    names = ["zan@thor.org", "ann@x.com", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567"]
    rows = [(0, None), (1, "")]
    for i in range(2, 90):
        words = [r.choice(("of", "the", "and", "in", "ou", "er")) + str(r.randint(0, 9)) for _ in range(r.randint(3, 60))]
        for e in range(len(names)):
            if r.random() < 0.15:
                at = r.randrange(len(words))
                words[at:at] = [f"Owner{e}", names[e], f"é{e}"]
        if r.random() < 0.1:
            words.append(f"owner{r.randrange(5)}")
        if r.random() < 0.1:
            words.append("glued4111111111111111tail")
        rows.append((i, " ".join(words)))
    found = {x["doc_id"]: listed({(s["start"], s["kind"], s["end"]) for s in x["spans"]}) for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = dict(zip((i for i, _ in rows), brute(rows), strict=True))
    assert found == want and sum("term" in x for x in want.values()) > 10


def test_query(spark, tiny):
    rows = {r["doc_id"]: r for r in pii.op3_pii(spark, tiny).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    for (i, text), spans in zip(texts, brute(texts), strict=True):
        r, want = rows[i], plain(text or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest() and r["spans"] == spans
