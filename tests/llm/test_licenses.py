"""Licence scans against every place of every template in plain Python."""

import math
import random
import re

from roadweave.llm import licenses
from roadweave.llm.common import table
from roadweave.llm.queries import op12_license_scan

DOCS = "doc_id long, text string, labels string, _text int"
OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def standing(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def expected(texts, templates=licenses.TEMPLATES, base=licenses.BASE):
    """Weighs every template at every place, its words looked for one by one."""
    docs = [words_of(t) for t in texts]
    sets = [set(d) for d in docs]
    out = []
    for words, own in zip(docs, sets, strict=True):
        starts = sorted(i for p, _ in base for i in standing(words, p.split()))
        labels = {label for p, label in base if standing(words, p.split())}
        every, score = set(labels), 1.0 if labels else 0.0
        for label, text, keys in templates:
            t = words_of(text)
            if not own & set(t):
                continue
            weights = [math.log((len(docs) + 1) / (sum(w in s for s in sets) + 1)) + 0.01 for w in t]
            for at in range(-len(t) - 2, len(words) + 3):
                held = [w in words[max(0, at + p - 2) : max(0, at + p + 3)] for p, w in enumerate(t)]
                cover = sum(w for w, x in zip(weights, held, strict=True) if x) / sum(weights)
                if cover >= 0.75 - 1e-9 and all(any(at - 2 <= i and i + len(k.split()) <= at + len(t) + 2 for i in standing(words, k.split())) for k in keys):
                    every.add(label)
                    score = max(score, min(1.0, cover))
        out.append((len(words), len(starts), *((starts[0], starts[-1]) if starts else (None, None)), ",".join(sorted(labels)), ",".join(sorted(every)), round(score, 9)))
    return out


def damaged(rng, text):
    words = words_of(text)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["x"], [words[i], "x"], [words[i], words[i]]])
    return rng.choice([" ", ", ", "-"]).join(w.upper() if rng.random() < 0.1 else w for w in words)


def made(rng, n):
    plain = ["the", "of", "mit", "software", "license", "public", "version", "é", "under", "2", "0", "wort"]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(plain, k=rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            parts += [damaged(rng, rng.choice(licenses.TEMPLATES)[1]), " ".join(rng.choices(plain, k=rng.randrange(9)))]
        texts.append("\n".join(parts))
    return texts


def rows_of(df):
    return [(*tuple(r)[:-1], round(r.score, 9)) for r in df.orderBy("doc_id").select(*OUT).collect()]


def test_against_every_place(spark):
    texts = made(random.Random(3), 160)
    got = rows_of(licenses.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)))
    assert got == expected(texts)
    assert sum(r[5] != r[4] for r in got) > 40 and sum(r[5] == "" for r in got) > 20


def test_where_the_words_are_common(spark):
    """All documents hold a notice, so that its words weigh next to nothing against those of others."""
    texts = ["Released under the MIT License."] * 30 + ["Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0 license", None, "", "mit license mit license", "public general license"]
    got = rows_of(licenses.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)))
    assert got == expected(texts)
    assert got[0][4:6] == ("mit", "mit") and got[30][5] == "cc-by-nc-4.0" and got[31][5] == "cc-by-4.0" and got[34][:4] == (4, 2, 0, 2)


def test_rows_of_all_kinds(spark):
    long = "word " * 150_000 + "Licensed under the Apache License, Version 2.0." + " license" * 50_000
    rows = [(1, long, "x", 1), (2, None, "x", 1), (2, "Apache  LICENSE", "x", 1), (2, "Apache  LICENSE", "x", 1), (None, "MIT-License", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "_text", *OUT, "places"]
    by = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.base_labels, r.labels) for r in got.collect())
    assert by == [(0, 2, 1, 0, "mit", "mit"), (1, 200_008, 1, 150_003, "apache", "apache,apache-2.0"), (2, 0, 0, None, "", ""), (2, 2, 1, 0, "apache", "apache"), (2, 2, 1, 0, "apache", "apache")]
    assert [(p.label, p.start) for r in got.where("doc_id = 1").collect() for p in r.places] == [("apache-2.0", 150_000)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_against_every_place(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = [r.text for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    got = op12_license_scan(spark, sf_dir)
    assert got.columns == ["doc_id", *OUT]
    assert rows_of(got) == expected(texts)
