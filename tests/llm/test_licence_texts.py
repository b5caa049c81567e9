"""Licence texts, wrapped notices and bare ids."""

import textwrap

from docketframe.llm import licences


def wrapped(text, width=72, prefix=""):
    return "\n".join(textwrap.wrap(text, width, initial_indent=prefix, subsequent_indent=prefix))


def test_texts_wrapped_notices_and_ids(spark):
    model = licences.train_licence_model(spark)
    full = {name: "Copyright (c) 2021 Ann Other\n\n" + "\n\n".join(wrapped(x) for x in licences.TEXTS[name]) for name in ("MIT", "BSD", "ISC")}
    cases = [(name, text) for name, text in full.items()]
    cases += [(name, "# Ann Other\n#\n" + "\n#\n".join(wrapped(x, 60, "# ") for x in licences.TEXTS[name])) for name in full]
    cases += [
        ("LGPL", "prose before it\nThis library is covered by the GNU Lesser\nGeneral Public License, version 2.1\nprose after it"),
        ("CC-BY", "The text is licensed under Creative\nCommons Attribution 4.0 International"), ("MIT", "Some words\nReleased under the MIT\nLicense."),
    ]
    cases += [(name, f"// SPDX-License-Identifier: {x}") for name, ids in licences.SPDX.items() for x in ids]
    table = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = licences.scan_licences(table, model).sort("doc_id").collect()
    wrong = [(cases[r.doc_id], r.family, r.families, r.confirmed, r.probability) for r in got if (r.family, r.confirmed) != (cases[r.doc_id][0], True)]
    assert wrong == []
    assert got[0].n_paragraphs >= 3 and got[6].families == ["LGPL"] and got[6].n_paragraphs == 1
    lone = spark.createDataFrame([(1, "Er kam mit dem Bus\nLicensed under GPLv2\nund ging mit dem Zug"), (2, "$$$\n" * 100_000 + "Released under MPL-2.0.")], "doc_id long, text string")
    assert [(r.families, r.n_paragraphs) for r in licences.scan_licences(lone, model).sort("doc_id").collect()] == [(["GPL"], 1), (["MPL"], 1)]
