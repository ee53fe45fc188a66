import random
import textwrap

from trackspark.llm import licenses as L

MIT = ["mit-grant", "mit-notice", "as-is", "mit-liability"]


def said(name):
    return L.SENTENCES[name][0] + "."


def brute(text):
    """The same rules as a plain walk: longest first, earliest match, leftmost of each identifier."""
    import re
    known = L.known()
    parts = [s for s in re.split(r"(?<=[.!?])\s+|[;:]\s|\s*[\r\n]+\s*", text or "") if s]
    ids = [i for s in parts if any(c in s.lower() for c in L.CUES) for i in [known.get(L.plain(s))] if i]
    rest, found = list(ids), []
    for name, wanted in L.rules():
        at, spots = 0, []
        for w in wanted:
            while at < len(rest) and rest[at] != w:
                at += 1
            if at == len(rest):
                break
            spots.append(at)
            at += 1
        if len(spots) == len(wanted):
            found.append(name)
            # every further occurrence of the whole sequence goes as well
            while len(spots) == len(wanted):
                rest = [x for k, x in enumerate(rest) if k not in spots]
                at, spots = min(spots) if False else spots[-1] + 1 - len(spots), []
                for w in wanted:
                    while at < len(rest) and rest[at] != w:
                        at += 1
                    if at == len(rest):
                        break
                    spots.append(at)
                    at += 1
    return ids, sorted(set(found))


def test_notices(documents):
    texts = {
        "\n".join(map(said, MIT)): ["MIT"],
        "Some code.\n" + said("bsd-grant") + " " + said("bsd-source") + "\nAn own sentence.\n" + said("bsd-binary"): ["BSD-2-Clause"],
        " ".join(map(said, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"])): ["BSD-3-Clause"],
        " ".join(map(said, ["bsd-binary", "bsd-source", "bsd-grant"])): [],
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "text. This work is licensed under the GNU General Public License, version 3.": ["GPL-3"],
        "LICENSED under CC   BY-NC 4.0.\nReleased under the MIT License.": ["CC-BY-NC-4.0", "MIT"],
        "This is not a licensed sentence we know.": [],
        "All rights reserved.": ["All-Rights-Reserved"],
    }
    out = L.scanned(documents(list(texts))).collect()
    assert [r.licenses for r in sorted(out, key=lambda r: r.doc_id)] == list(texts.values())
    assert {r.doc_id: r.unknown_sentences for r in out}[7] == 1


def test_equals_brute_force(documents):
    r = random.Random(3)
    names = [n for n in L.SENTENCES if "{v}" not in n and n != "gpl-free"]
    texts = [None, "", "no cue here."]
    texts += [" ".join(said(n) for n in r.choices(names, k=r.randrange(1, 7))) for _ in range(60)]
    for row in L.scanned(documents(texts)).collect():
        ids, found = brute(texts[row.doc_id])
        assert row.sentence_ids == ids
        assert row.licenses == found, texts[row.doc_id]


def test_every_known_sentence_has_a_cue_and_is_one_sentence(documents):
    for wordings in L.SENTENCES.values():
        assert all(any(c in w.lower() for c in L.CUES) for w in wordings)


def test_native_and_empty(documents):
    plan = L.scanned(documents(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert L.scanned(documents([])).count() == 0


def test_every_wording_is_recognised_also_wrapped(documents):
    """Plain, and wrapped at 60 to 80 columns, bare and in comments; beside lines that are not known."""
    want, texts = [], []
    for name, wordings in L.SENTENCES.items():
        assert len({len(L.parts(w)) for w in wordings}) == 1
        for w in wordings:
            ids = [n.replace("{v}", "2") for n in L.part_names(name, w)]
            w = w.replace("{v}", "2.0") + "."
            for width in (60, 66, 72, 80):
                for head in ("", " * ", "# ", "// "):
                    lines = "\n".join(head + x for x in textwrap.wrap(w, width))
                    texts.append(f"{head}Some heading\n{head}\n{lines}\n{head}\n{head}int x")
                    want.append(ids)
            texts += [w, w.replace(" ", "\r\n"), w.rstrip(".") + "\nint x = 1\nint y", "import this\n" + w]
            want += [ids] * 4
    out = {r.doc_id: r.sentence_ids for r in L.scanned(documents(texts)).collect()}
    assert [(texts[i], out[i]) for i in out if out[i] != want[i]] == []


def test_wrapped_notices(documents):
    def wrapped(names, head=""):
        paragraphs = [textwrap.wrap(said(n).replace("{v}", "3"), 72) for n in names]
        return f"\n{head}\n".join("\n".join(head + x for x in p) for p in paragraphs)
    texts = {
        "The MIT License (MIT)\nCopyright (c) 2020 Some One\n\n" + wrapped(MIT): ["MIT"],
        "/*\n" + wrapped(MIT, " * ") + "\n */\nint x;": ["MIT"],
        wrapped(["bsd-grant", "bsd-source", "bsd-binary"], "# "): ["BSD-2-Clause"],
        wrapped(["gpl-free", "gpl-warranty"], "# "): ["GPL-3-or-later"],
        wrapped(["gpl-free"]): ["GPL-3-or-later"],
        "# SPDX-License-Identifier: Apache-2.0\n# Copyright someone\nimport x": ["Apache-2.0"],
        "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If not": ["MPL-2.0"],
        "all rights\nreserved": ["All-Rights-Reserved"],
        "not under the\nMIT License but another": [],
    }
    out = L.scanned(documents(list(texts))).collect()
    assert [r.licenses for r in sorted(out, key=lambda r: r.doc_id)] == list(texts.values())
    assert {r.doc_id: r.unknown_sentences for r in out}[8] == 1
