import math

from tarn.llm import licenses


def cosine(line, body, weights):
    a, b = ({w: licenses._tokens(t).count(w) * weights.idf.get(w, weights.unknown) for w in licenses._tokens(t)} for t in (line, body))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b) if a and b else 0


FILES = [
    ("r/LICENSE", "Released under the MIT License."), ("r/a.py", "code"), ("r/sub/deep/b.py", ""), ("r/sub/COPYING.txt", "no statement here"),
    ("r/own/x.c", "intro\n/* Licensed under the Apache License, Version 2.0. */\nbody"), ("s/y.c", "nothing"), ("s2/LICENSE", "nothing at all"),
    ("top.txt", "All rights reserved."), ("alone.txt", None), (None, "All rights reserved."), ("t/LICENCE", "Permission is hereby granted,\nfree of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("t/u/z", "the version of the work"), ("r/a.py", "code"), ("rr/q.py", "x"), ("long", "word " * 100_000 + "\nLicensed under CC BY-NC 4.0."),
    ("r/sub/NOTICE", "This work is licensed under the GNU General Public License, version 3."), ("r/sub/LICENSE", "Licensed under CC BY 4.0."),
]


def test_scan(spark):
    df = spark.createDataFrame([(k, p, t, "x", "y") for k, (p, t) in enumerate(FILES)], "doc_id int, path string, text string, license string, directory string")
    found = [(r.path, r.license, r.basis, r.from_directory) for r in licenses.scan(df, keep=("doc_id",)).orderBy("doc_id").collect()]
    assert found == [
        ("r/LICENSE", "MIT", "own", None), ("r/a.py", "MIT", "inherited", "r"), ("r/sub/deep/b.py", "CC-BY-4.0", "inherited", "r/sub"),
        ("r/sub/COPYING.txt", "CC-BY-4.0", "inherited", "r/sub"), ("r/own/x.c", "Apache-2.0", "own", None), ("s/y.c", None, "none", None),
        ("s2/LICENSE", None, "none", None), ("top.txt", "Proprietary", "own", None), ("alone.txt", None, "none", None), (None, None, "none", None),
        ("t/LICENCE", "MIT", "own", None), ("t/u/z", "MIT", "inherited", "t"), ("r/a.py", "MIT", "inherited", "r"), ("rr/q.py", None, "none", None),
        ("long", "CC-BY-NC-4.0", "own", None), ("r/sub/NOTICE", "GPL-3.0", "own", None), ("r/sub/LICENSE", "CC-BY-4.0", "own", None)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_scores_and_needed_tokens(spark):
    weights = licenses.Weights()
    lines = [t for _, t in licenses.TEMPLATES] + ["Licensed under CC BY-NC 4.0. extra words here", "the work is version 3", "under the License", "MIT"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(lines)], "path string, text string")
    found = {r.path: r.score for r in licenses.scan(df).collect()}
    for k, line in enumerate(lines):
        best = max(round(cosine(line, body, weights), 6) for _, body in licenses.TEMPLATES)
        assert (found[str(k)] or 0) == (best if best >= licenses.SIMILAR else 0), line


def test_wrapped_header_repeated_path_and_clashing_columns(spark):
    wrapped = "# you may not use this file except in compliance\n# with the License. You may obtain a copy of the License\n# at http://www.apache.org/licenses/LICENSE-2.0\ncode"
    rows = [("a/x.py", wrapped), ("b/LICENSE", "nothing here"), ("b/LICENSE", "All rights reserved."), ("b/c/y", None), ("", "with")]
    df = spark.createDataFrame([(p, t, 1, "k") for p, t in rows], "path string, text string, unit int, k_path string")
    found = [(r.path, r.license, r.basis) for r in licenses.scan(df, keep=("k_path",)).collect()]
    assert sorted(found) == [
        ("", None, "none"), ("a/x.py", "Apache-2.0", "own"), ("b/LICENSE", "Proprietary", "own"), ("b/LICENSE", "Proprietary", "own"), ("b/c/y", "Proprietary", "inherited")]


def test_left_out_tokens_cannot_reach_the_threshold():
    weights = licenses.Weights()
    for _, vector in weights.vectors:
        assert math.sqrt(sum(x * x for w, x in vector.items() if w not in weights.needed)) < licenses.SIMILAR
    assert not weights.needed & {"the", "of", "and", "or", "to"}
