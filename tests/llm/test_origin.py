"""Origin of files: notices, the forest on held-out files, copies, data, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import origin as O


@pytest.mark.parametrize(
    "head,want",
    [
        ("// Code generated by x from y. DO NOT EDIT.", "generated"), ("# @generated by z", "generated"), ("// <auto-generated/>", "generated"), ("// Automatisch erzeugt aus a.idl, bitte nicht von Hand ändern.", "generated"),
        ("// Fichier produit par x à partir de y, ne rien modifier ici.", "generated"), ("// Produced by the x compiler (version 1.17), edit a.yaml instead.", "generated"), ("// This module writes files that carry a generated header, see the template below.", None),
        ("/*! leasekit v1.0.8 */", "banner"), ("// Copyright (c) the Ostler contributors, all rights kept.", "third"), ("// Copyright (c) the harbor-core team, internal use only.", "own"), ("// Part of the lintel library by its maintainers, see https://a.example for the original.", "third"),
        ("// This part of the code counts rows if the project has no owner.", None), ("", None), ("// SPDX-License-Identifier: MIT", "third"), ("// Output of the build step, regenerate it with make stubs.", "generated"),
    ],
)
def test_notices(head, want):
    top, body = O.notices(head + "\n\ncode();\n")
    assert O.notice_kind(top) == want and body.strip() == "code();"


def hand(rng, k):
    words = ["shift", "merge", "count", "frame", "token", "queue", "ledger", "window"]
    out = []
    for f in range(rng.randrange(3, 8)):
        out.append(f"# {rng.choice(['Moves', 'Keeps', 'Drops'])} the {rng.choice(words)} when the {rng.choice(words)} is late.\ndef {rng.choice(words)}_{rng.choice(words)}_{k}_{f}(a, b):")
        for _ in range(rng.randrange(3, 9)):
            out.append(rng.choice([f"    {rng.choice(words)} = {rng.choice(words)}(a, {rng.randrange(99)})", f"    if {rng.choice(words)} > {rng.randrange(999)}:\n        return b", f"    {rng.choice(words)}.append({rng.choice(words)})"]))
    return "\n".join(out) + "\n"


def machine(rng, k):
    return "\n".join(f'_FIELD_{k}_{i} = _descriptor.FieldDescriptor(name="field{rng.randrange(99)}", number={i}, type={rng.randrange(9)}, label=1, default=None)' for i in range(rng.randrange(20, 60))) + "\n"


def data(rng, k):
    return f"TABLE_{k} = [\n" + "".join("    " + ", ".join(f"{rng.uniform(-1, 1):.4f}" for _ in range(8)) + ",\n" for _ in range(40)) + "]\n"


def test_forest_copies_and_data(spark):
    rng = random.Random(4)
    rows, want = [], set()

    def add(project, path, text, bad):
        rows.append((len(rows), project, path, "python", ".py", "code", text.encode()))
        if bad:
            want.add(len(rows) - 1)

    for k in range(40):
        add(f"p{k % 5}", f"src/own{k}.py", "# Copyright (c) the p team, internal use only.\n\n" + hand(rng, k), False)
        add(f"p{k % 5}", f"src/gen{k}.py", "# Code generated by tool. DO NOT EDIT.\n\n" + machine(rng, k), True)
        add(f"p{k % 5}", f"src/plain{k}.py", hand(rng, 100 + k), False)
        add(f"p{k % 5}", f"generated/bare{k}.py", machine(rng, 100 + k), True)
    for k in range(10):
        add("p1", f"src/data{k}.py", data(rng, k), True)
        add("p1", f"vendor_portal/list{k}.py", "STEPS = [1, 2, 3, 4, 5, 6, 7, 8]\n" + hand(rng, 300 + k), False)
        lib = hand(rng, 500 + k)
        add("p1", f"lib/a{k}.py", "# Copyright (c) the Ostler contributors, all rights kept.\n" + lib, True)
        add("p1", f"lib/b{k}.py", lib.replace("\n", "\r\n"), True)
        shared = hand(rng, 700 + k)
        add("p2", f"x/a{k}.py", shared, True)
        add("p3", f"y/a{k}.py", shared, True)
        twin = hand(rng, 900 + k)
        add("p2", f"x/t{k}.py", twin, False)
        add("p2", f"x/u{k}.py", twin, False)
    df = spark.createDataFrame([*rows, rows[0]], "file_id long, project string, path string, language string, ext string, file_type string, content binary").withColumn("votes", F.lit("clash"))
    got = {r.file_id for r in O.not_hand_written(df).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) / (len(rows) - len(want)) <= 0.03


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "code", None), (2, "p", "a.py", "python", ".py", "code", b""), (None, "p", "a.py", "python", ".py", "code", b"x"), (3, "p", "a.md", None, ".md", "doc", b"# @generated"), (4, "p", "a.py", "python", ".py", "code", b"# @generated by x\nx = 1\n"), (5, "p", "b.py", None, None, None, b"x" * 300_000)]
    df = spark.createDataFrame(rows, "file_id long, project string, path string, language string, ext string, file_type string, content binary")
    assert {r.file_id for r in O.not_hand_written(df).collect()} == {4}
    assert O.not_hand_written(df.limit(0)).count() == 0 and O.scored(df.limit(0)).count() == 0


def test_figures_are_finite():
    for text in ("", "a", "\n\n", "x" * 10_000, "日本語\n"):
        assert all(v == v and abs(v) < 1e9 for v in O.figures(text, "python")) and len(O.figures(text, None)) == len(O.FIGURES)
