"""License blocks: planted notices, variants, and texts without any."""

import textwrap

from repolume.llm import licences, queries
from tests.llm.helpers import ODD_TEXTS, documents, prose

MIT = licences.TEMPLATES["MIT"][1]


def found_in(spark, rows):
    out = {}
    for r in licences.license_blocks(documents(spark, rows, clashing=True)).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_planted_notices(spark):
    words = " ".join(prose(1, 30))
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    at = 100
    wanted = {}
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            rows.append((at, f"{words}\n{text}\n{words}"))
            wanted[at] = name
            at += 1
    found = found_in(spark, rows + [rows[-1], (None, MIT)])
    for doc_id, name in wanted.items():
        blocks = found.pop(doc_id)
        assert {(b.license, b.status, b.first_line) for b in blocks} == {(name, "exact", 1)}
    assert {b.license for b in found.pop(None)} == {"MIT"} and not found


def test_variants_and_unknown_language(spark):
    changed = MIT.replace("free of charge", "without fee").replace("Software", "Program", 1)
    split = MIT.replace(". ", ".\n").replace(", to", ",\nto").replace("conditions: ", "conditions:\n")
    rows = [
        (1, changed),
        (2, split),
        (3, "The license of this text was never written down."),
        (4, "\n".join(["Released under the MIT License.", *prose(3, 9), "All rights reserved."])),
    ]
    found = found_in(spark, rows)
    assert [(b.license, b.status) for b in found[1]] == [("MIT", "variant")] and found[1][0].missing
    assert [b.license for b in found[2]] == ["MIT"]
    assert [(b.license, b.status) for b in found[3]] == [("unknown", "unconfirmed")]
    assert [b.license for b in sorted(found[4], key=lambda b: b.first_line)] == ["MIT", "Proprietary"]


def test_wrapped_notices(spark):
    """Every template at 60 to 80 columns, plain and as a comment, with the blank lines of the
    real files."""
    rows, wanted = [], []
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            for mark in ("conditions: ", "2.0. ", "License. ", "at ", "LICENSE-2.0 "):
                if name in ("MIT", "Apache-2.0", "BSD-3-Clause"):
                    text = text.replace(mark, mark.strip() + "\n\n")
            for width in range(60, 81):
                for prefix in ("", "# "):
                    parts = [textwrap.fill(p, width - len(prefix)) for p in text.split("\n\n")]
                    block = textwrap.indent("\n\n".join(parts), prefix, lambda line: True)
                    rows.append((len(rows), f"Words before it.\n\n{block}\n\nand words\nafter it."))
                    wanted.append((name, "exact", 2, 2 + block.count("\n")))
    found = found_in(spark, rows)
    for (i, text), name in zip(rows, wanted):
        got = [(b.license, b.status, b.first_line, b.last_line) for b in found.get(i, [])]
        assert got == [name], text


def test_every_notice_of_a_block(spark):
    """Notices on neighbouring lines, on one line, inside a long line, and one within another."""
    every = [(name, t) for name, texts in licences.TEMPLATES.items() for t in texts]
    names = sorted(name for name, _ in every)
    words = " ".join(prose(5, 900))
    apache = licences.TEMPLATES["Apache-2.0"][1]
    texts = {
        "All rights reserved.\nReleased under the MIT License.": ["MIT", "Proprietary"],
        MIT + "\n\n" + apache: ["Apache-2.0", "MIT"],
        "\n".join(t for _, t in every): names,
        " ".join(t for _, t in every): names,
        f"{MIT} {MIT}": ["MIT", "MIT"],
        MIT.replace("subject to", "All rights reserved. subject to"): ["MIT", "Proprietary"],
        f"{words} The license of this is not known. {words} {MIT}": ["MIT", "unknown"],
    } | {f"{words} {t} {words}": [name] for name, t in every}
    found = found_in(spark, list(enumerate(texts)))
    for i, (text, wanted) in enumerate(texts.items()):
        assert sorted(b.license for b in found.get(i, [])) == wanted, text


def test_query_finds_every_known_notice(spark):
    sf_dir = "/root/testdata/sf0.01"
    notices = [t for texts in licences.TEMPLATES.values() for t in texts]
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = {r.doc_id for r in texts if any(n in r.text for n in notices)}
    found = {r.doc_id for r in queries.op2_licenses(spark, sf_dir).collect() if r.status == "exact"}
    assert wanted and wanted <= found


def test_empty_table(spark):
    assert licences.license_blocks(documents(spark, [])).count() == 0
