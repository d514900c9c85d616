import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import licences
from pulsegrid.llm import near_vectors as near_vectors_module
from pulsegrid.llm.mixing import mix, mixed_documents
from pulsegrid.llm.near_vectors import near_vectors
from tests.llm.helpers import documents, empty, rows


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        target = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_of_odd_tables(spark):
    docs = documents(spark)
    out = mix(docs)
    sizes, own = defaultdict(int), {}
    for r in docs.collect():
        own[r["doc_id"]] = (len((r["text"] or "").encode().split()), r["source"])
        sizes[r["source"]] += own[r["doc_id"]][0]
    target = brute_targets(sizes)
    for r in out.collect():
        n, s = own[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * n and (not n or r["taken"] % n == 0)
    assert rows(out, "doc_id", "taken") == rows(mix(docs.repartition(5)), "doc_id", "taken")
    assert mix(empty(spark)).count() == 0


def test_mix_meets_targets_with_a_hot_source(spark):
    rng = np.random.default_rng(2)
    table = [(i, " ".join(["w"] * int(n)), f"s{0 if rng.random() < 0.4 else rng.integers(1, 6)}") for i, n in enumerate(rng.lognormal(3.5, 1, 3000))]
    out = mix(spark.createDataFrame(table, "doc_id long, text string, source string")).toPandas()
    out["source"] = [s for _, _, s in sorted(table)] if out.doc_id.is_monotonic_increasing else out.doc_id.map({i: s for i, _, s in table})
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target).all()


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    copies = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    made = mixed_documents(docs)
    assert made.columns == docs.columns
    assert Counter(r["doc_id"] for r in made.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    table = [(i, (base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25])).astype(np.float32).tolist(), int(i % 2)) for i in range(600)]
    odd = [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, table[0][1], None), (605, table[0][1], 0), (606, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors(df, shard=60).collect()}
    good = [*table, odd[5]]
    x = np.array([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[r[0]]["n_links"] for r in good])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.97 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (600, 601, 602, 603, 604, 606))
    assert got[605]["component_id"] == 0 and not got[605]["kept"]
    assert near_vectors(df.where("false")).count() == 0


def brute_licence(texts, unit):
    """Cosine of one statement to every template, by the definition."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    have = Counter(w for t in texts for w in set(words(t or "")))
    known = {w for ts in licences.TEMPLATES.values() for t in ts for w in words(t)}
    idf = lambda w: math.log((1 + len(texts)) / (1 + (have[w] if w in known else 0))) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    a, best = vector(unit), (0.0, None)
    for name in sorted(licences.TEMPLATES):
        for t in licences.TEMPLATES[name]:
            b = vector(t)
            dot = sum(v * b.get(w, 0) for w, v in a.items())
            score = round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6)
            best = max(best, (score, name), key=lambda x: (x[0], [-ord(c) for c in x[1] or ""]))
    return best


def test_licences_of_a_tree(spark):
    files = [
        ("a/LICENSE", "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software."), ("a/b/x.c", "int main"),
        ("a/b/y.c", "// Licensed under the Apache License, Version 2.0.\ncode"), ("z/q.c", None), ("a/b/c/COPYING", "GNU General Public License version 3"),
        ("a/b/c/d/e.c", ""), ("a/b/x.c", "int main"), ("k.c", "a licence of nobody that anybody knows about\nx"), ("ab/c.c", "x"),
    ]
    out = {r["path"]: r for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: (r["licence"], r["basis"], r["declared_in"]) for p, r in out.items()} == {
        "a/LICENSE": ("MIT", "file", None), "a/b/x.c": ("MIT", "directory", "a"), "a/b/y.c": ("Apache-2.0", "header", None), "z/q.c": (None, "none", None),
        "a/b/c/COPYING": ("GPL-3.0", "file", None), "a/b/c/d/e.c": ("GPL-3.0", "directory", "a/b/c"), "k.c": (None, "none", None), "ab/c.c": (None, "none", None),
    }
    texts = [t for _, t in files]
    for path, unit in (("a/LICENSE", texts[0]), ("a/b/y.c", texts[2].split("\n")[0]), ("a/b/c/COPYING", texts[4])):
        score, name = brute_licence(texts, unit)
        assert (round(out[path]["score"], 5), out[path]["licence"]) == (round(score, 5), name)


MIT = """MIT License

Copyright (c) 2021 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = """Copyright (c) 2020, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software.
"""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
MPL = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
"""


def test_whole_licence_texts_speak_for_their_directories(spark):
    texts = {"MIT": MIT, "BSD-3-Clause": BSD, "Apache-2.0": APACHE, "GPL-3.0": GPL, "MPL-2.0": MPL}
    names = ("LICENSE", "LICENSE.txt", "licence.md", "COPYING", "License-2")
    files = [(f"{k}/{n}", t) for (k, t), n in zip(texts.items(), names)] + [(f"{k}/src/deep/a.c", "int main(void);") for k in texts]
    files += [
        ("MIT/own.c", "/* Copyright 2019 Someone. All rights reserved. */\ncode"), ("closed/LICENSE", "Copyright 2018 Someone\r\nAll rights reserved."), ("closed/in/a.c", "x"),
        ("MPL-2.0/b.c", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.\nx"), ("none/b.c", "line\n\n"),
        ("two/LICENSE", MIT), ("two/COPYING", MIT), ("two/a.c", ""), ("other/notes.txt", MIT), ("other/a.c", ""),
    ]
    out = {r["path"]: (r["licence"], r["basis"], r["declared_in"]) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for (k, _), n in zip(texts.items(), names):
        assert out[f"{k}/{n}"] == (k, "file", None) and out[f"{k}/src/deep/a.c"] == (k, "directory", k)
    assert out["MIT/own.c"] == (licences.RESERVED, "header", None) and out["closed/in/a.c"] == (licences.RESERVED, "directory", "closed")
    assert out["MPL-2.0/b.c"] == ("MPL-2.0", "header", None) and out["none/b.c"] == (None, "none", None)
    assert out["two/a.c"] == ("MIT", "directory", "two") and out["other/notes.txt"][:2] == ("MIT", "header") and out["other/a.c"] == (None, "none", None)


def test_reserved_rights_are_named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    said = {r["doc_id"] for r in docs.where(r"text rlike '(^|\\n)All rights reserved\\.'").collect()}
    found = {r["doc_id"]: r["licence"] for r in licences.licence_rows(docs).where("licence is not null").collect()}
    assert len(said) > 50 and said <= set(found) and sum(found[i] == licences.RESERVED for i in said) >= 0.95 * len(said)


def test_licence_rows_of_odd_tables(spark):
    out = licences.licence_rows(documents(spark))
    assert out.count() == 17 and {r["basis"] for r in out.collect()} == {"none"}
    assert licences.licence_rows(empty(spark)).count() == 0


def tight_shard(n):
    """One shard whose members all link, as shard_search takes it."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(n, 64))
    near = [sorted({(i + k) % n for k in (1, 2, 5, 11, n - 1)}) for i in range(n)]
    return pa.table({"rep": list(range(n)), "shard": pa.array([0] * n, pa.int32()), "n": [1] * n, "embedding": x.tolist(), "shards": pa.array([[0]] * n, pa.list_(pa.int32())), "near": near})


def test_a_tight_shard_needs_no_memory_for_its_pairs():
    import tracemalloc

    group = tight_shard(1200)
    tracemalloc.start()
    out = near_vectors_module.shard_search(0.93)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out.column("links").to_pylist()) == {1199} and set(out.column("other").to_pylist()) == {0}
    assert peak < 200_000_000  # all pairs at once: 720,000 pairs of 1 KB


def test_labels_that_fail_the_audit_are_compared_whole(spark):
    """A tight group cut into many shards of few vectors: no allowed overlap finds its pairs."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=16) + 0.05 * rng.normal(size=(400, 16)), rng.normal(size=(100, 16))])
    df = spark.createDataFrame([(i, v, i % 5 == 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label boolean").withColumn("label", F.col("label").cast("int"))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, overlap=24, shard=4).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one = np.arange(500) % 5 == 0
    near = (x @ x.T >= 0.93) & (one[:, None] == one[None, :])
    found = np.array([got[i] for i in range(500)])
    assert (found <= near.sum(axis=1) - 1).all() and all(found[k].sum() >= 0.97 * (near.sum(axis=1) - 1)[k].sum() for k in (one, ~one))
    classes = df.select("label", "embedding", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n"))
    whole = near_vectors_module.compared(classes, 0.93, block=30).groupBy("rep").agg(F.sum("links").alias("n")).collect()
    assert {r["rep"]: r["n"] for r in whole} == {i: int(k) for i, k in enumerate(near.sum(axis=1) - 1) if k}


def test_vectors_of_any_magnitude(spark):
    """The smallest and largest doubles, signs, and pairs on either side of the threshold; both routes decide alike."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 6))
    near = base[:20] + rng.normal(size=(20, 6)) * 0.2
    at = np.array([[1.0, 0, 0, 0, 0, 0], [0.93, np.sqrt(1 - 0.93**2), 0, 0, 0, 0], [0.9299, np.sqrt(1 - 0.9299**2), 0, 0, 0, 0]])
    plain = np.concatenate([base, near, at])
    power = rng.integers(-900, 900, len(plain))
    table = lambda m: spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(m)], "vec_id long, label int, embedding array<double>")
    want = near_vectors_module.cosines(np.repeat(plain, len(plain), axis=0), np.tile(plain, (len(plain), 1))).reshape(len(plain), -1) >= 0.93
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(table(np.ldexp(plain, power[:, None])), shard=30).collect()}
    assert [got[i] for i in range(len(plain))] == (want.sum(axis=1) - 1).tolist() and sum(got.values()) > 20
    tiny = near_vectors(table(np.array([[1e-200, 0.0], [0.9e-200, 0.1e-200], [1e300, 1e299], [-1e300, 0.0]]))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in tiny} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}
    classes = table(np.ldexp(plain, power[:, None])).selectExpr("label", "vec_id as rep", "1L as n", "embedding")
    whole = near_vectors_module.compared(classes, 0.93, block=25).groupBy("rep").agg(F.sum("links").alias("n")).collect()
    assert {r["rep"]: r["n"] for r in whole} == {i: int(w) for i, w in enumerate(want.sum(axis=1) - 1) if w}
