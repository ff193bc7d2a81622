"""Operator 1 against a brute-force version in Python."""

import hashlib
import random
import re

import numpy as np

from cairn.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    out.sort()
    return [f"{k}:{s}:{e}" for s, _, k, e in out]


CASES = [
    None, "", " ", "a@b.c_d@e.f", "a@b@c.de x@y z.z@q.q.", "é😀 joe%x@mail.example.com, ☃ 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 0000.01.2.255 256.0.0.1",
    "4539 1488 0343 6467 and 4539-1488-0343-6467 4539148803436468 6011000990139424", "+1 (974) 555-3436 +12 +1+1234567890123 +1 (2) 3. 4-5 6 7 8 9 0 1 2",
    "x" * 50_000 + "@a.b", "1" * 60_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 30_000, "1.1.1.1" * 3000, "5 " * 20_000 + "5",
    "tab\there\n8.8.8.8\n\nme@x.yy\x00\x7f", "😀" * 300 + " a@b.cd " + "😀1.2.3.4",
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(CASES)] + [(3, CASES[3], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, kind int")
    got = pii.digest(pii.find(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(CASES[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(pii.find(docs)).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(brute(texts[r.doc_id])).encode()).hexdigest()


def test_terms_that_reveal_an_entity(spark):
    filler = [f"common words fill line {i} of this ordinary text about nothing much" for i in range(300)]
    planted = [f"case {i} the zanzibarix project lead writes from boss@corp.example.com about common words" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(filler + planted)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    terms = {t.value for t in found[301].terms}
    assert "zanzibarix" in terms and "common" not in terms and "words" not in terms
    assert not found[5].terms
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "boss@corp" not in clean[301] and "[email]" in clean[301] and "zanzibarix" not in clean[301] and "common words" in clean[301]
    assert clean[5] == filler[5]


def test_copies_are_no_evidence(spark):
    text = "unusualword stands by solo@one.example.com here"
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(9, "other text")], "doc_id long, text string")
    assert not any(r.terms for r in pii.find(df).collect())


def test_copies_are_no_counter_evidence(spark):
    filler = [f"common words fill line {i} of this ordinary text about nothing much" for i in range(300)]
    texts = [f"case {i} begins. The zanzibarix lead writes from boss@corp.example.com about common words {i * 7}." for i in range(2)]
    far = " More common words fill this ordinary text about nothing much. Then more of it follows in a line like that."
    copies = texts * 400 + [t + far + f" Near copy {i}." for i in range(200) for t in texts]
    df = spark.createDataFrame(list(enumerate(filler + copies)), "doc_id long, text string")
    found = [r for r in pii.find(df).collect() if r.doc_id >= len(filler)]
    assert len(found) == len(copies) and all("zanzibarix" in {t.value for t in r.terms} for r in found)
    assert not any(t.value == "common" for r in found for t in r.terms)


def test_terms_go_from_the_whole_document(spark):
    filler = [f"common words fill line {i} of this ordinary text about nothing much" for i in range(300)]
    planted = [f"case {i} zanzibarix boss@corp.example.com and {'common ' * (9 + i)}wo quuxologistic words" for i in range(2)]
    long = "Zanzibarix opens. " + "common words fill this line. " * 20 + "From boss@corp.example.com now. " + "common words fill this line. " * 20 + "QUUXOLOGISTIC, Zanzibarix"
    df = spark.createDataFrame(list(enumerate([*filler, *planted, long, "zanzibarix alone"])), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(300, 303):
        assert "zanzibarix" not in clean[i].lower() and "quuxologistic" not in clean[i].lower() and "common" in clean[i]
    assert clean[303] == "zanzibarix alone"


def brute_terms(docs, generalise=pii.GENERALISE, support=pii.SUPPORT):
    """Disclosure by plain loops over the documents: (doc_id, start, end, term, disclosure) of each added span."""
    term = re.compile(pii.TERM)
    lines, found, near = set(), {}, {}
    for d, t in docs:
        pieces = re.split(pii.LINE_END, t or "")
        at = lambda i: pieces[i] if 0 <= i < len(pieces) else ""
        lines |= {(at(i - 1), x, at(i + 1)) for i, x in enumerate(pieces) if x}
        found[d] = []
        for kind, pattern in PLAIN.items():
            every = list(re.finditer(pattern, t or ""))
            ends = [0, *[m.end() for m in every]]
            starts = [*[m.start() for m in every], len(t or "")]
            for k, m in enumerate(every):
                if f"{kind}:{m.start()}:{m.end()}" not in brute(t):
                    continue
                entity = kind + ":" + re.sub(r"[\x20().-]", "", m[0]).lower()
                found[d].append((entity, m.start(), m.end()))
                left, right = t[ends[k] : m.start()], t[m.end() : starts[k + 1]]
                a, b = max(0, len(left) - pii.REACH), min(len(right), pii.REACH)
                while 0 < a and term.fullmatch(left[a - 1 : a + 1]):  # to the end of a word that the cut goes through
                    a -= 1
                while b < len(right) and term.fullmatch(right[b - 1 : b + 1]):
                    b += 1
                window = (left[a:], right[:b])
                for w in {x.lower() for side in window for x in term.findall(side) if len(x) >= pii.MIN_TERM}:
                    near.setdefault(entity, {}).setdefault(w, set()).add(window)
    cf, chars = {}, 0
    for _, x, _ in lines:
        chars += len(x)
        for w in term.findall(x):
            cf[w.lower()] = cf.get(w.lower(), 0) + 1
    n = max(2.0, chars / (2 * pii.REACH))
    strong = {}
    for entity, terms in near.items():
        n_c = len(set().union(*terms.values()))
        for w, seen in terms.items():
            if len(seen) >= support:
                pmi = np.log2(len(seen) * n / (n_c * max(cf.get(w, 0), len(seen))))
                share = min(1.0, pmi / -np.log2(min(n_c / n, 0.5)))
                if share >= generalise:
                    strong.setdefault(entity, {})[w] = share
    out = []
    for d, t in docs:
        mine = {}
        for entity, _, _ in found[d]:
            for w, share in strong.get(entity, {}).items():
                mine[w] = max(share, mine.get(w, 0))
        for m in term.finditer(t or ""):
            if m[0].lower() in mine and not any(s < m.end() and m.start() < e for _, s, e in found[d]):
                out.append((d, m.start(), m.end(), m[0].lower(), round(mine[m[0].lower()], 4)))
    return sorted(out)


def test_disclosure_matches_plain_loops(spark):
    r = random.Random(3)
    common = [f"word{i}" for i in range(40)] + ["Élan", "ΟΔΟΣ", "ab", "x-y", "İstanbul"]
    rare = [f"Codename{i}" for i in range(8)] + ["ΛΟΓΟΣ", "supercalifragilistic" * 5]
    entities = [f"boss{i}@corp.example.com" for i in range(4)] + ["10.20.30.40", "+1 (974) 555-3436", "4539 1488 0343 6467"]
    docs = []
    for i in range(250):
        w = [r.choice(common) for _ in range(r.randrange(5, 60))]
        if r.random() < 0.35:
            k = r.randrange(len(entities))
            for x in (rare[k], entities[k], rare[(k + r.randrange(3)) % len(rare)]):
                w.insert(r.randrange(len(w)), r.choice([x, x + ".", x + ",\n"]))
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:60])] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x.doc_id, t.start, t.end, t.value, round(t.disclosure, 4)) for x in pii.find(df).collect() for t in x.terms)
    want = brute_terms(docs)
    assert len({w for *_, w, _ in want}) > 5 and got == want


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
