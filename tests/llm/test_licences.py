from pathlib import Path

from docstrata.llm.licence_texts import KNOWN, UNLICENSE
from docstrata.llm.licences import all_digests, canonical_text, known_digests, scan_licences


def test_scan(spark):
    mit = "Copyright (c) 2020 Some One\n * All rights reserved.\n\n" + KNOWN["MIT"].replace("sublicense", "sub-license").replace(" ", "\n * ").upper()
    rows = [(1, mit), (2, KNOWN["ISC"]), (3, None), (4, ""), (5, "Copyright 2021 x\n!!"), (6, KNOWN["MIT"] + " extra"), (7, "é" * 100_000), (8, "© 2020 A\n" + KNOWN["BSD-3-Clause"].replace("\n\n", "\n"))]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS licence")).collect()}
    assert {k: got[k].licence for k in got} == {1: "MIT", 2: "ISC", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "BSD-3-Clause"}
    assert all(got[k].n_words == len(canonical_text(t).split()) for k, t in rows)
    assert len({d for _, d in known_digests()}) == len(KNOWN)
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_usual_files(spark):
    year = "Copyright (c) 2020 Some One\n\n"
    apache = Path("/usr/share/common-licenses/Apache-2.0")
    texts = {
        "MIT": "MIT License\n\n" + year + KNOWN["MIT"],
        "BSD-3-Clause": "BSD 3-Clause License\n\n" + year + "All rights reserved.\n\n" + KNOWN["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "),
        "BSD-2-Clause": "The 2-Clause BSD License\n" + KNOWN["BSD-2-Clause"],
        "ISC": "ISC License\n\n" + year + KNOWN["ISC"].replace("and/or", "and"),
        "MIT-0": "MIT No Attribution\n\n" + year + KNOWN["MIT-0"],
        "Unlicense": UNLICENSE.format(url="https://unlicense.org"),
        **({"Apache-2.0": apache.read_text().replace("[yyyy] [name of copyright owner]", "2021 Some One")} if apache.exists() else {}),
    }
    rows = [*enumerate(texts.values()), (100, "MIT License"), (101, "MIT License\n" + KNOWN["ISC"])]
    got = {r.doc_id: r.licence for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(texts)), 100: None, 101: None}
    digests = all_digests()
    assert len({d for _, d in digests}) == len(digests) and set(known_digests()) <= set(digests)


def test_lines_are_taken_out_as_stated(spark):
    """The pattern that reads each line once takes out what the plain one does."""
    import random
    import time

    from pyspark.sql import functions as F

    from docstrata.llm.licences import canonical

    r = random.Random(2)
    bits = ["©", "(c)", "(", ")", "c)", "copyright", "2020", "20", "by ", "the ", " ", "*", "\n", "all rights reserved", "x", "é", "-", "Copyright (C) 2019 A\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["©copyright 2020", "(c)(c)", "((c) 1999", "© © x", "©" * 9, "©©\nx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical(F.col("t")).alias("f")).collect()
    assert [x.f for x in sorted(rows)] == [canonical_text(t) for t in texts]
    begin = time.time()
    long = ["©" * 100_000, "(" * 100_000, "(c" * 50_000, "\n©" * 50_000, "copyright" + " " * 100_000, "-" * 100_000]
    assert scan_licences(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).where("licence IS NULL").count() == len(long)
    assert time.time() - begin < 10


def test_boost(spark):
    from docstrata.llm.licence_texts import BOOST

    rows = [(1, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST), (2, BOOST.replace("license", "licence"))]
    assert [x.licence for x in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == ["BSL-1.0"] * 2
