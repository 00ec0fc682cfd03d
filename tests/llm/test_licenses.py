import re

from lodestone.llm import licenses as L


def brute(text):
    folded = re.sub("[^a-z0-9\n]+", " ", (text or "").translate(str.maketrans(L._UPPER, L._LOWER)))
    units = folded.split("\n")
    blocks = re.split("\n ?\n", folded)
    if len(blocks) > 1:
        units += [b for b in blocks if "\n" in b]
    found = []
    for k, unit in enumerate(units):
        own = set(L.bigrams_of(unit))
        for place, (name, template) in enumerate(L.TEMPLATES.items()):
            other = set(L.bigrams_of(template))
            if own and 2 * len(own & other) / (len(own) + len(other)) >= L.LEAST:
                found.append((-2 * len(own & other) / (len(own) + len(other)), place, k, name))
    if not found:
        return None, None, None, 0
    best = min(found)
    return best[3], -best[0], best[2], len({f[2] for f in found})


def test_brute_force(spark):
    texts = [None, "", "x", "\n\n", "Released under the MIT license", "released, under: the MIT  LICENSE!\nand more\nLicensed under CC BY 4.0", "nothing here\n" * 3000]
    for template in L.TEMPLATES.values():
        ws = template.split()
        texts += [template, "before\n" + template.upper() + "\nafter", "a paragraph\n\n" + " ".join(ws[: len(ws) // 2]) + "\n" + " ".join(ws[len(ws) // 2 :]) + "\n\nend", " ".join(ws[2:]), " ".join(ws[::2]), template + " and then some more words follow here for a while"]
    texts += texts[:3]
    frame = spark.createDataFrame([(k, t, "MIT") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    for r in L.scan(frame).collect():
        name, dice, unit, n = brute(texts[r["id"]])
        assert (r["license"], r["unit"], r["n_matches"]) == (name, unit, n), texts[r["id"]]
        assert dice is None or abs(r["dice"] - dice) < 1e-12
    assert L.scan(frame.limit(0)).count() == 0


def wrapped(text, columns):
    import textwrap

    return "\n".join(textwrap.wrap(text, columns))


def brute_runs(text):
    """The best licence over all runs of whole lines, of any length."""
    lines, best = text.split("\n"), (0, "")
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            own = set(L.bigrams_of(" ".join(lines[i:j])))
            for name, template in L.TEMPLATES.items():
                other = set(L.bigrams_of(template))
                best = max(best, (2 * len(own & other) / (len(own) + len(other)) if own else 0, name))
    return best if best[0] >= L.LEAST else (None, None)


def test_notices_wrapped_over_lines(spark):
    names = ["ISC", "MIT-permission", "GPL-3.0-header", "CC0-1.0"]
    notices = [wrapped(L.TEMPLATES[n], 72 if n != "CC0-1.0" else 40) for n in names]
    texts = [form.format(n) for n in notices for form in ("{}", "Copyright 2021 Example Ltd\n{}\nand more lines\nof other things", "some code\n\n * x\n{}\nend\n\nmore")]
    texts += ["Released\nunder the MIT\nLicense.", "Licensed under CC BY 4.0\nx\n" + notices[0], notices[0] + "\nx\n" + notices[0], "the license\nof nothing\nat all"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in L.scan(frame).collect()}
    for k, text in enumerate(texts):
        dice, name = brute_runs(text)
        assert got[k]["license"] in (name, "CC-BY-4.0-short"), text
        # A paragraph that matches is a unit as it is.
        assert dice is None or abs(got[k]["dice"] - dice) < (1e-12 if "\n\n" not in text else 0.1), text
    assert [got[k]["license"] for k in range(12)] == [n for n in names for _ in range(3)]
    assert [got[k]["unit"] for k in range(2)] == [0, 1]
    assert [got[k]["n_matches"] for k in (0, 1, 12, 13, 14, 15)] == [1, 1, 1, 2, 2, 0]


def test_anchors_cover_every_match():
    """Whatever part of a template can match holds an anchor."""
    words = L.anchors(L.TEMPLATES, L.LEAST)
    for template in L.TEMPLATES.values():
        bs = L.bigrams_of(template)
        bare = [b for b in bs if not any(c == b or c in b.split() for c in words)]
        assert len(bare) < L.LEAST / (2 - L.LEAST) * len(bs)


def test_a_licence_of_several_paragraphs(spark):
    paragraphs = [" ".join(f"{name}{k}word" for k in range(25)) for name in ("first", "second", "third")]
    template = {"Long-1.0": "\n\n".join(paragraphs)}
    texts = ["\n\n".join(paragraphs), "intro line\n\n" + "\n\n".join(paragraphs) + "\n\nand code follows", "\n\n".join(paragraphs[:1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["license"], r["dice"]) for r in L.scan(docs, templates=template).collect()}
    assert got == {0: ("Long-1.0", 1.0), 1: ("Long-1.0", 1.0), 2: (None, None)}
