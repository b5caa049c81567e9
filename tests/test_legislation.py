import random

import docketframe as d

CODE = "/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html"
CDSA = "/en/ca/laws/stat/sc-1996-c-19/latest/sc-1996-c-19.html"

def cited(spark, documents):
    rows = spark.createDataFrame(list(enumerate(documents)), "doc_id int, paragraphs array<string>")
    ranked = d.ordered_legislation(rows).orderBy("doc_id", "rank").collect()
    out = {i: [] for i in range(len(documents))}
    for r in ranked:
        out[r.doc_id].append((r.name, r.section, r.para_nos))
    return out


def test_whole_statute_gives_way_to_its_sections(spark):
    documents = [[
        "Nothing here.",
        f"[718]({CODE}#sec718_smooth), [718.1]({CODE}#sec718.1_smooth) of the _[Criminal Code]({CODE})_",
        f"s 109 of the _[Criminal Code]({CODE})_ and [a case](/en/ab/abca/doc/2013/2013abca255.html)",
    ]]
    assert cited(spark, documents)[0] == [
        ("Criminal Code", "sec718", [2]), ("Criminal Code", "sec718.1", [2]), ("Criminal Code", None, [3]),
    ]


def test_written_documents(spark):
    documents = [
        ["[x](/en/ab/abca/doc/1.html) and [y](/fr/ca/lois/x.html)"],
        [f"[a]({CODE}#s1_smooth) [b]({CODE}#s1)", f"[a]({CODE}#s1)"],
        [f"[a]({CODE.replace('latest/', 'latest/ ')})", "[broken](", "[]()"],
        ["[t](/x#laws)", "[t](/en/ab/laws/y.html)"],
        [f"[t]({CDSA}#)", f"[t]({CDSA})"],
    ]
    assert cited(spark, documents) == {
        0: [], 1: [("Criminal Code", "s1", [1, 2])], 2: [("Criminal Code", None, [1])],
        3: [("/x", "laws", [1]), ("/en/ab/laws/y.html", None, [2])],
        4: [("Controlled Drugs and Substances Act", "", [1]), ("Controlled Drugs and Substances Act", None, [2])],
    }


def test_numbers_ascend_and_sections_win(spark):
    rng = random.Random(5)
    bits = [f"[t]({CODE})", f"[t]({CODE}#s1)", f"[t]({CODE}#s2)", f"[t]({CDSA})", "text"]
    documents = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 6))] for _ in range(200)]
    for found in cited(spark, documents).values():
        assert all(numbers == sorted(set(numbers)) for _, _, numbers in found)
        for name, section, numbers in found:
            if section is None:
                assert not set(numbers) & {n for other, s, ns in found if other == name and s for n in ns}


def test_lists_follow_first_appearance(spark):
    rows = spark.createDataFrame([(1, [f"[c]({CDSA}) [a]({CODE}#z)", f"[a]({CODE}#a)"])], "doc_id int, paragraphs array<string>")
    (row,) = d.legislation_lists(rows).collect()
    assert [tuple(e) for e in row.cited_legislation] == [
        ("Controlled Drugs and Substances Act", None, [1]), ("Criminal Code", "z", [1]), ("Criminal Code", "a", [2]),
    ]
