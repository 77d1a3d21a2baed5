import random
import re
import time

from fieldshift.llm import license_rules, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow(text):
    words = WORD.findall(lower(text))
    places = sorted((i, label) for p, label in BASE.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
    spans = [
        (m.start(), m.end(), r.priority, r.label) for r in license_rules.build() for m in re.finditer(r.pattern, " ".join(words))
    ]

    def hidden(s):
        def before(o):
            return (o[0], -o[1], -o[2], o[3]) < (s[0], -s[1], -s[2], s[3])

        return any(o[0] <= s[0] and o[1] >= s[1] and o[2] >= s[2] and (o[:3] != s[:3] or before(o)) for o in spans if o != s)

    kept = [s for s in spans if not hidden(s)]
    base = {label for _, label in places}
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {s[3] for s in kept})),
    )


def some_texts():
    rng = random.Random(6)
    texts = [None, "", "--- !!", "MIT License", "mit-license. apache\nlicense! General Public  License", "Émit license", "mit licenses"]
    texts += ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    texts += ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"]
    texts += ["https://www.apache.org/licenses/LICENSE-2.0", "mit license " * 500, "word " * 20000]
    bits = "mit license apache license gnu general public license version 3 licensed under the cc by nc 4 0 lesser".split()
    return texts + [" ".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(120)]


def test_hundreds_of_rules_and_sound_keywords():
    rules = license_rules.build()
    assert len(rules) >= 200 and all(r.keywords for r in rules)
    for text in some_texts():
        normal = licenses.normal_form((text or "").encode()).decode()
        for r in rules:
            if re.search(r.pattern, normal):
                assert all(k in normal for k in r.keywords), r


def test_against_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:7] == slow(t), t
        assert 0 <= got[i].score <= 1 and (got[i].score > 0) == bool(got[i].labels)


def test_grants_hide_the_mentions_inside_them():
    spans = licenses.Scanner().detect("licensed under the apache license version 2 0")
    assert {s[3] for s in spans} == {"apache-2.0"}
    assert licenses.suppress([(0, 5, 1, "a"), (0, 5, 1, "b"), (1, 4, 2, "c"), (1, 3, 1, "d")]) == [(0, 5, 1, "a"), (1, 4, 2, "c")]


def test_empty_and_null_ids(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "mit license"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in licenses.scan(odd).collect()) == [(0, 1), (1, 0), (1, 0)]


def test_time_grows_with_the_text():
    scanner = licenses.Scanner()
    start = time.process_time()
    got = scanner.scan(b"mit license " * 100_000)
    assert got[:4] == (200_000, 100_000, 0, 199_998) and time.process_time() - start < 10
    assert len(got[7]) == 100_000 and got[7][-1][2:] == (199_998, 199_999)
    start = time.process_time()
    assert licenses._words_before(licenses.np.full(200_000, 32), list(range(100_000)))[-1] == 99_999
    assert time.process_time() - start < 1


def test_written_rules_are_told_from_those_that_follow():
    written = [p for table in (license_rules.NAMES, license_rules.PASSAGES, license_rules.ADDRESSES) for _, ps in license_rules._lines(table) for p in ps]
    assert len(written) == len(set(written)) == license_rules.WRITTEN and len(license_rules.build()) > 2 * 200
