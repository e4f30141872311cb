"""Quality rules, token counts, packing, chat format, licences, mixing and language identification."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldguard.llm import chat_format, language_id, license_scan, mixing, packing, quality_rules, queries, token_counts, tokens

from .conftest import EDGES

SF = "/root/testdata/sf0.001"
BLANK = r"[\x20\x09-\x0D]+"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_prefix_counts_equal_the_library():
    counter, tokenizer, rng = token_counts.PrefixCounter(tokens.vocabulary_path()), library(), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "don't", "é", "你好", "🙂", "23", "!", "<|endoftext|>", "<|endo", "|>", "\x85", "\x1c", "\0", "ing", "\r\n", "'ll"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert counter.of_text(text).tolist() == [len(tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_token_counts_on_edge_cases(edges, no_rows):
    tokenizer = library()
    got = sorted(map(tuple, token_counts.token_counts(edges, limit=20, prefixes=True).collect()), key=repr)
    want = []
    for i, text, *_ in EDGES:
        text = text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        table = token_counts.PrefixCounter(tokens.vocabulary_path()).of_text(text).tolist() if len(text) < 1000 else None
        want.append((i, len(text.encode()), n, n > 20, table))
    assert sorted([(g[0], g[1], g[2], g[3], g[5] if len(g[5]) < 1000 else None) for g in got], key=repr) == sorted(want, key=repr)
    for g in got:
        assert g[5][g[4]] <= 20 or not g[3]
        assert not g[3] or all(c > 20 for c in g[5][g[4] + 1 :])
    assert token_counts.token_counts(no_rows).count() == 0


def test_packing_places_every_token_once(edges, no_rows, spark):
    tokenizer = library()
    got = packing.pack_documents(edges).collect()
    want = collections.Counter()
    for i, text, *_ in EDGES:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at, number = 0, 0
        while at < len(ids):
            to = at + (len(ids) - at - 1) % 1024 + 1
            want[i, number, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, number = to, number + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences(got)
    assert packing.pack_documents(no_rows).count() == 0


ODD_PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "你好", "🙂", "23", "!", "<|endoftext|>", "<|endo", "|>", "\x85", "\x1c", "\0", "\r\n", "\u3000", "\xa0", "\x0b", "Ġ"]


def test_arrow_cuts_texts_like_single_ones():
    rng = random.Random(3)
    texts = ["", " ", "\n", *("".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    for column in (pa.array(texts), pa.array(["left out", *texts], pa.large_string()).slice(1)):
        words, places, sizes = tokens.distinct_pieces(column)
        assert len(set(words)) == len(words)
        flat = iter([words[i] for i in places.to_pylist()])
        assert [[next(flat) for _ in range(n)] for n in sizes] == [tokens.pieces(t) for t in texts]


def test_pieces_are_encoded_together_and_as_the_library_does(monkeypatch):
    import tokenizers

    calls, path = [], tokens.vocabulary_path()
    real = tokenizers.Tokenizer.from_file(path)

    class Counting:
        get_vocab = real.get_vocab

        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda _: Counting())}))
    monkeypatch.setattr(packing, "_ENCODERS", {})
    known = packing._encoder(path)
    rng = random.Random(5)
    plain = [" " + "".join(rng.choice(["ab", "c", "é", "!", "7", "你", "<|endoftext|>"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    words = sorted(set(plain) | {"", " ", "\n", " a b", " a ", " x" * 3, "no", " \tx", " a\xa0", " x\ty", " " + "long" * 40})
    want = [np.array(real.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert known.results(words) == want
    assert sum(calls) < len(words) / 16  # most travel together
    assert known.results(words[::-1]) == want[::-1] and " " + "long" * 40 not in known and sum(calls) < len(words) / 16


def check_sequences(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing_exchanges_between_units_and_nears_the_bound(spark):
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 1025, 3000), rng.integers(300, 420, 1000)])
    rows = [(i, i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    parts = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack(parts, unit_rows=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    assert check_sequences(got) <= 1.01 * len(packing.best_fit(lengths, 1024)[2])


def test_rounds_go_on_while_they_save_sequences(spark):
    rng = np.random.default_rng(11)
    lengths = rng.integers(200, 500, 6000)  # two or three to a sequence: small units leave much room
    rows = [(i, i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    parts = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack(parts, unit_rows=200)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == list(range(6000))
    used = check_sequences(found)
    report = packing.packing_report(got).first()
    assert (report.sequences, report.bound) == (used, packing.lower_bound(lengths, 1024)) and report.gap == used - report.bound
    one_round = sum(len(packing.best_fit(lengths[rng.permutation(6000)][i : i + 200], 1024)[2]) for i in range(0, 6000, 200))
    assert packing.lower_bound(lengths, 1024) <= used <= one_round
    assert packing.packing_report(packing.pack(parts.limit(0))).first().asDict() == {"sequences": 0, "bound": 0, "gap": 0}


def test_lower_bound_is_one_and_best_fit_reaches_it():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 17, rng.integers(1, 12))
        bins, offsets, free = packing.best_fit(lengths, 16)
        assert np.bincount(bins, lengths).max() <= 16 and packing.lower_bound(lengths, 16) <= len(free)
    assert packing.lower_bound(np.array([600, 600, 600]), 1024) == 3
    assert packing.lower_bound(np.array([400, 400, 400, 400, 400]), 1024) == 3


def test_base_rules_on_edge_cases(edges, no_rows):
    no_reference = quality_rules.References({}, {})
    repeats = [(50, "a b\n\n a b\nc # d\na b\n"), (51, "x1 x2 x3 x4 x5 x6 x7 x8 y x1 x2 x3 x4 x5 x6 x7 x8 z"), (52, "p q r s t u v w " * 3)]
    docs = edges.unionByName(edges.sparkSession.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in repeats], edges.schema))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs, no_reference).collect()), key=repr)
    want = []
    for i, text, *_ in [*EDGES, *repeats]:
        text = text or ""
        words = [w for w in re.split(BLANK, text) if w]
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)))
    assert got == sorted(want, key=repr)
    assert quality_rules.quality_rules(no_rows, quality_rules.learn_references(no_rows)).count() == 0


def test_verdicts_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.quality_rules(docs, quality_rules.learn_references(docs)).join(labels, "doc_id").filter("NOT base_failed")
    kept = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True]
    assert kept.get((0, True), 0) <= 0.2 * max(1, kept.get((0, False), 0))


def test_distance_is_zero_for_equals_and_one_for_strangers():
    p = np.array([[0.5, 0.5, 0], [0, 0, 1]])
    assert quality_rules.distance(p, np.array([0.5, 0.5, 0])).round(9).tolist() == [0, 1]


def test_chat_round_trip(spark):
    said = ["", None, "plain", "</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "<\\|end|>", "[\\\\INST]", "<|part|>", "a\\", "$1 \\1", "🙂é\n", "x" * 5000]
    rng, rows = random.Random(2), []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 30)):
            rows.append((conv, rng.choice([turn, None, 3]), rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(said), "clash"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat_format.format_conversations(df)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(back) == set(by)
    for conv, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[conv].turns] == [t[1:] for t in turns]
        assert back[conv].loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_and_inheritance(spark):
    rows = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/x.py", "print(1)"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d.py", None), (5, "a/b/e.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), (6, None, "All rights reserved"),
        (7, "z//y.txt", "my licence to drive"), (8, "ab/x.py", ""), (9, "a/b/NOTICE.md", "nothing"), (10, None, ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, path string, text string, licence string")
    out = license_scan.license_scan(df)
    got = {r.doc_id: (r.licence, r.inherited_from) for r in out.collect()}
    assert got == {
        1: ("MIT", None), 2: ("MIT", ""), 3: ("Apache-2.0", None), 4: ("Apache-2.0", "a/b"), 5: ("GPL-3.0", None), 6: ("all-rights-reserved", None),
        7: ("MIT", ""), 8: ("MIT", ""), 9: ("Apache-2.0", "a/b"), 10: (None, None),
    }
    assert license_scan.license_scan(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_absolute_paths_repeated_rows_and_long_texts(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3"
    rows = [
        (1, "/a/LICENSE", mit), (2, "/a/x.c", "int x;"), (3, "/a/b/c/y.c", ""), (4, "/z.c", ""), (5, "//a//w.c", None),
        (6, "q/LICENSE", gpl), (7, "q/long.c", "word five " * 300_000), (7, "q/long.c", "word five " * 300_000), (8, "/q/x.c", ""),
    ]
    got = sorted((r.doc_id, r.licence, r.inherited_from) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect())
    assert got == [
        (1, "MIT", None), (2, "MIT", "/a"), (3, "MIT", "/a"), (4, None, None), (5, "MIT", "/a"),
        (6, "GPL-3.0", None), (7, "GPL-3.0", "q"), (7, "GPL-3.0", "q"), (8, None, None),
    ]


def test_mixing_meets_its_rates(spark, table, no_rows):
    rows = [(i, "x" * 10, "en", None if i % 10 == 0 else "big" if i % 10 < 8 else "small") for i in range(4000)]
    docs = table(rows)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 0.0)], "source string, weight double")
    rates = mixing.source_rates(docs, weights)
    by = {r.mix_source: r.rate for r in rates.collect()}
    assert by[None] == 0 and by["big"] == pytest.approx(20000 / 28000) and by["small"] == pytest.approx(20000 / 8000)
    mixed = mixing.mix(docs, rates, seed=3)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"} and abs(counts["big"] - 2000) < 200 and abs(counts["small"] - 2000) < 250
    copies = mixed.groupBy("doc_id", "mix_copy").count()
    assert copies.filter("count > 1").isEmpty() and mixed.columns[: len(docs.columns)] == docs.columns
    large = mixing.poisson_copies(docs, spark.createDataFrame([("big", 900.0)], "mix_source string, rate double")).filter("row.source = 'big'")
    mean, spread = large.agg(F.avg("copies"), F.variance("copies")).first()
    assert abs(mean - 900) < 5 and abs(spread - 900) < 120
    assert mixing.mix(no_rows, mixing.source_rates(no_rows)).count() == 0


def test_mixing_takes_any_other_column_and_repeated_ids(spark, table):
    docs = table([(1, "a", "en", "s"), (1, "a", "en", "s"), (2, None, "en", None), (None, "b", "en", "s"), (3, "c" * 400_000, "en", "t")])
    wide = docs.selectExpr("*", *[f"doc_id AS {n}" for n in ("rate", "blocks", "below", "mix_source", "copies", "row", "place", "terms", "copy", "n.dot".replace(".", "_"))])
    many = spark.createDataFrame([("s", 3.0), (None, 3.0), ("t", 3.0)], "mix_source string, rate double")
    plain = sorted((r.doc_id is not None, r.doc_id or 0, r.mix_copy, r.mix_order, r.text) for r in mixing.mix(docs, many).collect())
    mixed = mixing.mix(wide, many)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.mix_copy, r.mix_order, r.text) for r in mixed.collect()) == plain and plain
    assert mixed.columns == [*wide.columns, "mix_rate", "mix_copy", "mix_order"]
    assert mixed.filter("NOT (rate <=> doc_id) OR NOT (row <=> doc_id)").isEmpty()
    ones = collections.Counter(r[2] for r in plain if r[1] == 1)
    assert all(n == 2 for n in ones.values())  # rows that repeat share their draw
    for name in ("mix_rate", "mix_copy", "mix_order"):
        with pytest.raises(ValueError, match=name):
            mixing.mix(docs.withColumn(name, F.lit(1)), many)


def test_language_of_held_out_documents(spark, edges, no_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(edges, model).collect()}
    assert pred[1] == pred[2] == pred[3] == ("und", 0.0) and pred[4][0] in model.languages
    assert language_id.predict(no_rows, language_id.train(no_rows)).count() == 0
    assert {r.lang_pred for r in language_id.predict(edges, language_id.train(no_rows)).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    lengths, k = np.array([3, 1, 4]), 3
    scores, moves = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    p, expected = language_id.forward_backward(scores, np.array([0, 3, 4]), lengths, moves)
    want, pairs = np.zeros((8, k)), np.zeros((k, k))
    for start, n in zip([0, 3, 4], lengths, strict=True):
        paths = list(itertools.product(range(k), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[start + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))) for path in paths])
        for path, w in zip(paths, weight / weight.sum(), strict=True):
            for i, y in enumerate(path):
                want[start + i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                pairs[a, b] += w
    assert np.allclose(p, want) and np.allclose(expected, pairs)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    want = con.sql(queries.ORACLE_SQL[name]).project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert got == sorted(map(tuple, want), key=repr)


def test_repeated_ids_take_no_language_from_the_sample(spark, table):
    """A language whose ids repeat fills no other language's place among the learning rows."""
    some = [(i, f"alpha beta gamma {i}", "aa", "s") for i in range(1, 60)] * 30 + [(i, f"один два три {i}", "zz", "s") for i in range(100, 160)]
    model = language_id.train(table(some), language_id.CrfSettings(documents_per_language=20))
    out = language_id.predict(table([(7, "один два", None, "s"), (8, "alpha gamma", None, "s")]), model)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {7: "zz", 8: "aa"}


def test_no_reference_rejects_documents_it_cannot_speak_for(table):
    rng = random.Random(4)
    common = ["the", "of", "and", "a", "to", "in"]

    def prose(letters, short=()):
        return " ".join(rng.choice(short) if short and rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(150)) + "."

    latin, korean, arabic = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하", "ابتثجحخدذرزسشصضطظعغ"
    documents = [(i, prose(latin, common), "en", "s") for i in range(40)]
    documents += [(100 + i, prose(korean), "ko", "s") for i in range(19)] + [(200, prose(korean), None, "s"), (201, prose(arabic), "ar", "s"), (202, prose(arabic), "en", "s")]
    documents += [(210, prose(latin, ["cua", "va", "mot"]), "vi", "s")]
    junk = [(300, " ".join(rng.choice(["#$%", "&*|", "<>9", "7&1"]) + str(rng.randint(0, 999)) for _ in range(150)), None, "s"), (301, prose(latin), "en", "s")]
    docs = table(documents + junk)
    judged = {r.doc_id: r for r in quality_rules.quality_rules(docs, quality_rules.learn_references(docs)).collect()}
    assert sorted(i for i, r in judged.items() if not r.kept) == [300, 301]
    assert all(judged[i].class_distance is None and judged[i].word_distance is None for i in (100, 118, 200, 201, 202))
    assert judged[210].class_distance is not None and judged[210].word_distance is None
    more = table(documents + [(119, prose(korean), "ko", "s")])
    assert sorted(quality_rules.learn_references(more).scripts.items()) == [("en", {"LATIN"}), ("ko", {"HANGUL"})]


def test_wrapped_headers_and_licence_files(spark):
    gnu = """/* This program is free software{}: you can redistribute it and/or modify
 * it under the terms of the GNU {} as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
int main(void) {{ return 0; }}"""
    bsd = """# Copyright (c) 2020, A. Writer. All rights reserved.
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
"""
    texts = {
        "GPL-3.0": gnu.format("", "General Public License", "3"),
        "GPL-2.0": gnu.format("", "General Public License", "2"),
        "LGPL-2.1": gnu.format("", "Lesser General Public License", "2.1"),
        "AGPL-3.0": gnu.format("", "Affero General Public License", "3"),
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nfn main() {}",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
        "BSD-2-Clause": bsd,
        "BSD-3-Clause": bsd + "# 3. Neither the name of the copyright holder nor the names of its\n#    contributors may be used to endorse or promote products.\n",
    }
    head = "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble\n"
    rows = [(i, f"own/{name}.c", text) for i, (name, text) in enumerate(texts.items())]
    rows += [(50, "lib/COPYING", head), (51, "lib/src/a.c", "int a;"), (52, "x.c", "the GNU people and their permission")]
    got = {r.doc_id: (r.licence, r.inherited_from) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {i: (name, None) for i, name in enumerate(texts)} | {50: ("GPL-3.0", None), 51: ("GPL-3.0", "lib"), 52: (None, None)}


def test_full_sequences_of_a_unit_that_missed_its_bound_are_not_certified(spark):
    lengths = [2, 3, 5, 6, 7, 2, 2, 3]  # best fit takes four sequences, the bound is three
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    parts = spark.createDataFrame(rows, "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(parts, capacity=10).collect()
    missed = len({r.sequence_id for r in got}) > packing.lower_bound(np.array(lengths), 10)
    assert missed and not any(r.certified for r in got)


def test_a_very_long_conversation_takes_time_in_proportion(spark):
    took = {}
    for n in (500, 8_000):
        df = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "repeat('word five ', 60) AS text")
        start = time.monotonic()
        row = chat_format.read_back(chat_format.format_conversations(df)).first()
        took[n] = time.monotonic() - start
        assert len(row.turns) == n and len(row.loss_text) == 600 * (n // 2)
    assert took[8_000] < 16 * took[500] + 20
