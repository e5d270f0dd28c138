"""License scans of licence texts as they stand in files: wrapped at several widths, with notices."""

import textwrap

import pytest

from lectern.llm import license_scan

SCHEMA = "doc_id long, text string"
WIDTHS = (30, 40, 60, 65, 68, 70, 72, 76, 78, 79, 80, 100, 1000)


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def scan(spark, texts):
    return {r.doc_id: r.license for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_wrap_widths(spark):
    names, texts = [], []
    for name, text in license_scan.LICENSES.items():
        for width in WIDTHS:
            title, _, rest = wrapped(text, width).partition("\n\n")
            names += [name, name]
            texts += [f"{title}\n\n{rest}", f"{title}\n\nCopyright (c) 2011-2020, Some Body <a@b.org>\nAll rights reserved.\n\n{rest}"]
    got = scan(spark, texts)
    assert [(n, k) for k, n in enumerate(names) if got[k] != n] == []


@pytest.mark.parametrize(
    ("line", "gone"),
    [
        ("Copyright (c) 2020 Somebody", True),
        ("Copyright 1999-2020, The Authors", True),
        ("# Copyright © Acme", True),
        ("   COPYRIGHT 2001 ACME", True),
        ("Copyright The Regents of the University", True),
        ("Copyright by Somebody", True),
        ("Copyright: Acme Inc", True),
        ("Copyright [yyyy] [name of copyright owner]", True),
        ("Copyright (C) <year> <name of author>", True),
        ("(c) 2020 Acme", True),
        ("(C) Acme Inc.", True),
        ("© Acme", True),
        ("All rights reserved.", True),
        ("copyright notice and this permission notice appear in all copies.", False),
        ("COPYRIGHT HOLDERS AND CONTRIBUTORS", False),
        ("COPYRIGHT OWNER OR CONTRIBUTORS", False),
        ("copyright license to reproduce", False),
        ("Copyright and Related Rights", False),
        ("copyright the software, and", False),
        ("copyrighted by somebody", False),
        ("(c) You must retain, in the Source form", False),
        ("c) You must cause", False),
    ],
)
def test_notice_lines(spark, line, gone):
    text = f"first\n{line}\nlast"
    made = spark.createDataFrame([(text,)], "text string").select(license_scan.canonical(license_scan.F.col("text")).alias("c")).first().c
    assert (made == "first last") == gone


def test_full_texts(spark):
    """A document that is a licence in full is found, with and without its title."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts here")
    files = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = {name: (folder / file).read_text("utf-8") for file, name in files.items()}
    rows = [(n, t) for n, t in texts.items()] + [(n, t.upper() if n == "MPL-2.0" else "\n\n" + t.replace("\n", "\r\n")) for n, t in texts.items()]
    rows += [(n, texts[n][texts[n].index("Preamble") :].partition("END OF TERMS AND CONDITIONS")[0]) for n in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1")]
    rows += [(n, wrapped(texts[n], w)) for n in ("Apache-2.0", "CC0-1.0", "MPL-2.0") for w in (50, 72, 1000)]
    rows += [(None, texts["GPL-3.0"] + "and more"), (None, texts["GPL-3.0"][:-200])]
    got = scan(spark, [t for _, t in rows])
    assert [(n, got[k]) for k, (n, _) in enumerate(rows) if got[k] != n] == []


def test_without_title(spark):
    names = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib"]
    got = scan(spark, ["Copyright (c) 2020 Somebody\n\n" + wrapped(license_scan.LICENSES[n], 70).partition("\n\n")[2] for n in names])
    assert [got[k] for k in range(len(names))] == names
