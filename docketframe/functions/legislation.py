"""Column functions for links to statutes inside Markdown paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketframe.functions.text import let

# Fixed values.
LINK_PATTERN = r"\[([^\]]+)\]\(([^)]+)\)"
STATUTE_URL_MARK = "laws"
SECTION_NOISE = "_smooth"
STATUTE_NAMES = {
    "/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html": "Criminal Code",
    "/en/ca/laws/stat/sc-1996-c-19/latest/sc-1996-c-19.html": "Controlled Drugs and Substances Act",
    "/en/ca/laws/stat/schedule-b-to-the-canada-act-1982-uk-1982-c-11/latest/schedule-b-to-the-canada-act-1982-uk-1982-c-11.html": "Charter",
    "/en/ca/laws/stat/rsc-1985-c-c-47/latest/rsc-1985-c-c-47.html": "Criminal Records Act",
    "/en/ca/laws/stat/sc-2001-c-27/latest/sc-2001-c-27.html": "Immigration and Refugee Protection Act",
}


def statute_urls(paragraph: Column) -> Column:
    """Link targets of a paragraph that point at statutes, spaces removed, in order."""
    urls = F.transform(
        F.regexp_extract_all(paragraph, F.lit(LINK_PATTERN), F.lit(2)),
        lambda url: F.replace(url, F.lit(" "), F.lit("")),
    )
    return F.filter(urls, lambda url: F.contains(url, F.lit(STATUTE_URL_MARK)))


def statute_name(url: Column) -> Column:
    """Name of a known statute, else its URL; both without the section part."""
    page = F.substring_index(url, "#", 1)
    known = F.create_map(*[F.lit(x) for pair in STATUTE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(known, page), page)


def statute_section(url: Column) -> Column:
    """Section part of the URL; empty after a bare ``#``, NULL without one."""
    at = F.instr(url, "#")
    return F.when(at > 0, F.replace(F.substr(url, at + 1), F.lit(SECTION_NOISE), F.lit("")))


def paragraph_links(paragraph: Column, para_no: Column) -> Column:
    """Statute links of a paragraph: ``key, para_no, pos, counted, name, section``.

    ``key`` tells statutes and their sections apart. A link without a section does not count in a paragraph that also
    has one to a section of the same statute; an empty section neither displaces nor is displaced.
    """

    def marked(links: Column) -> Column:
        sectioned = F.transform(F.filter(links, lambda x: x["section"] != ""), lambda x: x["name"])

        def rows(names: Column) -> Column:
            return F.transform(
                links,
                lambda x, i: F.struct(
                    F.concat_ws("#", x["name"], x["section"]).alias("key"),
                    para_no.alias("para_no"),
                    i.alias("pos"),
                    (x["section"].isNotNull() | ~F.array_contains(names, x["name"])).alias("counted"),
                    x["name"].alias("name"),
                    x["section"].alias("section"),
                ),
            )

        return let(F.array_distinct(sectioned), rows)

    named = F.transform(
        statute_urls(paragraph), lambda url: F.struct(statute_name(url).alias("name"), statute_section(url).alias("section"))
    )
    return let(named, marked)


def legislation_entries(paragraphs: Column) -> Column:
    """Statutes cited by the paragraphs of one decision: ``name, section, para_nos`` in order of first appearance.

    Works inside the row. Links are sorted by statute and place, so that each entry is a run of neighbours; the work
    is that of a sort of the decision's links.
    """

    def entry(links: Column) -> Column:
        first = F.get(links, F.lit(0))
        counted = F.transform(F.filter(links, lambda x: x["counted"]), lambda x: x["para_no"])
        return F.struct(
            first["para_no"].alias("para_no"),
            first["pos"].alias("pos"),
            first["name"].alias("name"),
            first["section"].alias("section"),
            F.array_distinct(counted).alias("para_nos"),
        )

    def runs(links: Column) -> Column:
        opens = F.transform(links, lambda x, i: F.when((i == 0) | (F.get(links, i - 1)["key"] != x["key"]), i))

        def entries(starts: Column) -> Column:
            def run(start: Column, nth: Column) -> Column:
                end = F.coalesce(F.get(starts, nth + 1), F.size(links))
                return let(F.slice(links, start + 1, end - start), entry)

            return F.transform(starts, run)

        return let(F.filter(opens, lambda x: x.isNotNull()), entries)

    links = F.flatten(F.transform(paragraphs, lambda text, p: F.coalesce(paragraph_links(text, p + 1), F.array())))
    used = F.filter(let(F.array_sort(links), runs), lambda x: F.size(x["para_nos"]) > 0)
    return F.transform(F.array_sort(used), lambda x: x.dropFields("para_no", "pos"))
