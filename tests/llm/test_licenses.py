import hashlib
import os
import re

import pytest

from nearvote.llm.licenses import CLAIM, DIGESTS, KNOWN, LicenseConfig, NOTICES, RESERVED, SPELLINGS, TERMS, read_digests, scan_licenses


def canonical(text):
    form = re.sub(TERMS, r"copyright\1", text or "")
    form = re.sub(CLAIM, r"\1", form).lower()
    form = re.sub(RESERVED, r"\1", form)
    for a, b in SPELLINGS:
        form = re.sub(a, b, form)
    return re.sub(r"[\W_]+", " ", form).strip()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_whole_texts_in_any_dress(docs):
    mit = KNOWN[0][1]
    dressed = "Copyright (c) 2021 Some One\nAll rights reserved.\n\n" + mit.upper().replace('"', "''").replace("\n", "\n   * ")
    rows = [(1, mit), (2, dressed), (3, mit.replace("sublicense", "sub-license").replace("copies", "copies,")), (4, mit + " and more"), (5, None), (6, ""), (7, "© 2020 Someone\n" + next(t for name, t in KNOWN if name == "ISC"))]
    got = {r["doc_id"]: r for r in scan_licenses(docs(rows)).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, None, "ISC"]
    assert got[1]["digest"] == got[2]["digest"] == got[3]["digest"]
    assert got[5]["digest"] == got[6]["digest"] == sha("")


def test_copyright_lines_of_any_form_are_left_out(docs):
    mit = KNOWN[0][1]
    heads = ["# Copyright (c) 2020 X", "// Copyright Jane Doe 2020", " * Copyright: 2020 X", "Copyright Jane Doe", "Copyright (c) <year> <holder>", "Copyright [yyyy] [name of owner]", "(C) 2001-2020 X", "COPYRIGHT (C) 1999 X\nCopyright by Some One", "/* All rights reserved. */"]
    wrapped = mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("copyright notice", "\ncopyright notice")
    rows = [(i, h + "\n\n" + mit) for i, h in enumerate(heads)] + [(50, wrapped), (51, "\n".join("# " + x for x in mit.split("\n")))]
    assert [r["license"] for r in scan_licenses(docs(rows)).collect()] == ["MIT"] * len(rows)
    kept = [(0, "Copyright Notice of this kind"), (1, "COPYRIGHT HOLDERS AND OTHERS"), (2, "(c) You must keep it")]
    assert sorted(r["digest"] for r in scan_licenses(docs(kept)).collect()) == sorted(sha(canonical(t)) for _, t in kept)
    assert all(len(canonical(t)) > 10 for _, t in kept)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licence texts")
def test_long_licences_are_known_by_digest(spark, docs):
    folder = "/usr/share/common-licenses"
    found = dict(read_digests(spark, folder))
    known = {d for _, d in DIGESTS}
    assert {found[n] for n in ("GPL-2", "GPL-3", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0") if n in found} <= known
    texts = [(n, open(f"{folder}/{n}").read()) for n in ("GPL-3", "Apache-2.0") if n in found]
    got = scan_licenses(docs([(i, t.replace("\n", "\r\n").upper() if i else t) for i, (_, t) in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["license"] for r in got][:1] == ["GPL-3.0"]


def test_equals_brute_force(docs, odd_texts):
    notices = [t for _, t in KNOWN if "\n" not in t and len(t) < 100]
    rows = odd_texts + [(100 + i, f"Some prose.\n  {n.upper()}  \nmore\nLicence unknown\n{notices[0]}") for i, n in enumerate(notices)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(KNOWN)]
    table = {sha(canonical(t)): name for name, t in KNOWN}
    by_line = {sha(canonical(t)): name for name, t in NOTICES}
    got = {r["doc_id"]: r for r in scan_licenses(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        lines = [c for c in map(canonical, (t or "").split("\n")) if len(c) >= 8]
        hits = [by_line[sha(c)] for c in lines if sha(c) in by_line]
        r = got[i]
        assert r["digest"] == sha(canonical(t)) and r["license"] == table.get(sha(canonical(t)))
        assert (r["n_lines"], r["line_licenses"]) == (len(hits), ",".join(sorted(set(hits))))


def test_configured_catalogue_repeats_and_empty_tables(docs):
    config = LicenseConfig(known=(("Own-1", "You may use this."), ("Own-0", "you MAY use this")))
    rows = docs([(1, "You may use this!"), (1, "You may use this!"), (None, "x")])
    assert sorted((r["doc_id"] is None, r["license"]) for r in scan_licenses(rows, config).collect()) [:2] == [(False, "Own-0")] * 2
    assert scan_licenses(docs([])).count() == 0
    plan = scan_licenses(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
