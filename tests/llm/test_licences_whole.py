"""Licence files as they are found: with titles, named owners, line ends, and inside other text."""

from pathlib import Path

import pytest

from loamtree.llm import license_scan

COMMON = Path("/usr/share/common-licenses")


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.license, r.notices, r.n_notices) for r in sorted(license_scan.license_scan(docs).collect(), key=lambda r: r.doc_id)]


def test_titles_owners_and_paragraphs(spark):
    known = dict(reversed(license_scan.KNOWN))
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    wrapped = mit.replace(", to any", ",\nto any").replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    bsd = known["BSD-3-Clause"].replace(" 2. ", "\n2. ").replace("the copyright holder nor", "the University nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    code = "import os\n\n" + "\n".join(("# " + x).rstrip() for x in wrapped.split("\n")) + "\n\nprint(1)\n"
    out = scan(spark, [f"MIT License\n\nCopyright (c) 2020 Someone\n\n{wrapped}\n", f"Copyright 1990 The Regents\nAll rights reserved.\n\n{bsd}", code, "Other\n\nReleased under\nthe MIT License.\n\nmore", "MIT License", "other text\n\nand more"])
    assert [x[0] for x in out] == ["MIT", "BSD-3-Clause", None, None, None, None]
    assert out[0][1:] == ("MIT", 1) and out[2][1:] == ("MIT", 1) and out[3][1:] == ("MIT", 1) and out[4][1:] == out[5][1:] == ("", 0)


def test_lines_that_begin_with_the_word(spark):
    """Licences wrapped so that a line begins with "copyright" keep that line; lines that state a holder go."""
    known = dict(reversed(license_scan.KNOWN))
    isc = known["ISC"].replace("above copyright notice", "above\ncopyright notice").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    bsd = known["BSD-2-Clause"].replace("BY THE COPYRIGHT HOLDERS", "BY THE\nCOPYRIGHT HOLDERS").replace("above copyright", "above\n# copyright")
    mit = dict(license_scan.KNOWN[:1])["MIT"].replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS").replace("above copyright", "above\ncopyright")
    heads = ["ISC License\n\nCopyright (c) 2004-2010 by Someone\nCopyright Other Person\n\n", "BSD 2-Clause License\n\nCopyright © 2020, Regents\nAll rights reserved.\n\n", "The MIT License (MIT)\n\n(c) Someone\n\n"]
    out = scan(spark, [h + t for h, t in zip(heads, (isc, bsd, mit))] + ["This is free\n\n" + known["Unlicense"], "# SPDX-License-Identifier: Apache-2.0\ncode"])
    assert [x[0] for x in out] == ["ISC", "BSD-2-Clause", "MIT", None, None]
    assert out[4][1:] == ("Apache-2.0", 1)


def test_sql_has_the_same_rules(spark, tmp_path):
    from oracle import assert_same

    known, path = dict(reversed(license_scan.KNOWN)), str(tmp_path)
    mit = dict(license_scan.KNOWN[:1])["MIT"].replace(", to any", ",\nto any").replace(" The above", "\n\nThe above").replace("above copyright", "above\ncopyright")
    texts = [
        f"MIT License\n\nCopyright (c) 2020 Someone\n\n{mit}\n", known["BSD-3-Clause"].replace("the copyright holder nor", "the University nor"), f"# code\r\n\n{mit}\n\nmore", "Other\n\nReleased under\nthe MIT License.\n \n\nmore",
        None, "", "\n\n", "Copyright\tNotice\n(c) me\n\u00a9 you\u2028copyright x\rcopyright y", "Licensed under CC BY 4.0.\nlicensed  under cc-by 4.0", "SPDX-License-Identifier: MIT",
    ]
    texts += [f.read_text() for f in sorted(COMMON.glob("*")) if COMMON.is_dir() and f.is_file() and not f.is_symlink()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    assert_same(spark, "op9", license_scan.op9_license_scan, license_scan.OP9_SQL, path)


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts at hand")
def test_full_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    assert [x[0] for x in scan(spark, [(COMMON / f).read_text() for f in files])] == list(files.values())
