"""Templates for designs that no template reads: DOM paths of a design's sample pages are aligned, and what repeats becomes a recipe.

Designs are clusters of the fingerprints of unread pages. One task for each design (a few sample pages) proposes a template with ranked alternatives
for each of its recipes. All proposals are then tried at once, in a graph where each is bound to its design, by the same extraction that runs in
production; what goes wrong with a design's samples repairs its proposal (the next alternative, a dropped field, added vocabulary, the next block), until nothing is left to try.
"""
from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.scalars import CURRENCIES
from ..functions.urls import absolute
from ..sources.staging import Stage, stage
from . import rules as R
from .frontier import spread
from .induction import cluster_designs


@dataclass(frozen=True)
class TemplateLimits:
    """Sample pages a design, designs a call (those of most pages first; None: all), bits of a design, repairs (None: until nothing is left to try), and least shares of pages that are taken and of items that are valid."""

    samples: int = 4
    designs: int | None = None
    distance: int = 10
    repairs: int | None = None
    taken: float = 0.6
    valid: float = 0.6
    advert_links: int = 3


#: Designs that are tried at once: the driver holds their templates and reports, proposals stay in tasks, and all designs come to their turn.
AT_ONCE = 500
_MONEY = re.compile("|".join(p for _, p in CURRENCIES), re.IGNORECASE)
_DATE = re.compile(r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b")
#: What a value of a field looks like, and words of its label or its element's class.
_LOOKS = {
    "price": (re.compile(rf"(?:{_MONEY.pattern}).*\d|\d.*(?:{_MONEY.pattern})", re.IGNORECASE | re.DOTALL), re.compile(r"price|cost|سعر", re.IGNORECASE)),
    "area": (re.compile(r"\d\s*(?:m²|m2\b|sqm|sq\.?\s*m|متر)", re.IGNORECASE), re.compile(r"area|size|surface|مساحة", re.IGNORECASE)),
    "bedrooms": (re.compile(r"^\D{0,20}\d{1,2}\s*(?:bed|br\b|غرف)", re.IGNORECASE), re.compile(r"bed|غرف", re.IGNORECASE)),
    "bathrooms": (re.compile(r"^\D{0,20}\d{1,2}\s*(?:bath|حمام)", re.IGNORECASE), re.compile(r"bath|حمام", re.IGNORECASE)),
    "listed_at": (_DATE, re.compile(r"date|posted|listed|time|تاريخ", re.IGNORECASE)),
    "location": (re.compile(r"(?!)"), re.compile(r"\bloc|place|address|city|district|موقع", re.IGNORECASE)),
    "listing_type": (re.compile(r"^\s*(?:for\s+)?(?:sale|rent)\s*$|^(?:للبيع|للإيجار|للايجار)$", re.IGNORECASE), re.compile(r"purpose|deal|listing-?type|offer", re.IGNORECASE)),
}
#: Wording of the two listing types, added where a site's vocabulary lacks it.
_TYPES = (("SALE", r"\b(?:for\s+)?sale\b|للبيع|تمليك"), ("RENT", r"\b(?:for\s+|to\s+)?(?:rent|let)\b|للإيجار|للايجار|إيجار"))
_TYPE = re.compile("|".join(p for _, p in _TYPES), re.IGNORECASE)


def _signature(node: H.Node) -> str:
    """Tag and first class, where that can stand in a selector."""
    first = next((c for c in (node.attrs.get("class") or "").split() if re.fullmatch(r"[A-Za-z_][\w-]*", c) and not re.search(r"\d", c)), None)
    return node.tag + (f".{first}" if first else "")


def _steps(node: H.Node, top: H.Node) -> tuple[str, ...]:
    out = []
    while node is not top and node.parent is not None:
        out.append(_signature(node))
        node = node.parent
    return tuple(reversed(out))


def _shown(root: H.Node) -> list[H.Node]:
    return [n for n in root.walk() if n.tag not in H.IGNORED]


def _leaves(top: H.Node) -> dict[tuple[str, ...], list[tuple[H.Node, str]]]:
    """Elements that hold text of their own, or a link or picture, by path below ``top``."""
    out = defaultdict(list)
    for node in _shown(top):
        own = H.clean(" ".join(c for c in node.children if isinstance(c, str)))
        if own or node.tag in ("img", "a"):
            out[_steps(node, top)].append((node, H.clean(node.text())))
    return out


def _blocks(pages: Sequence[R.Page]) -> list[tuple[str, list[list[H.Node]]]]:
    """Selectors of elements that repeat on the sample pages and hold a link and several texts, the best first, with their elements on each page."""
    counts = [Counter(_steps(n, p.body) for n in _shown(p.body)) for p in pages]
    found = []
    for path in dict.fromkeys(p for c in counts for p in c):
        if len(path) < 1 or path[-1].split(".")[0] in ("a", "b", "i", "p", "br", "span", "img", "option", "script", "input"):
            continue
        if sum(c[path] >= 2 for c in counts) < max(1, TemplateLimits.taken * len(pages)):
            continue
        for k in range(1, min(len(path), 3) + 1):
            css = " > ".join(path[-k:])
            nodes = [H.select(p.body, css) for p in pages]
            if all(len(ns) == c[path] for ns, c in zip(nodes, counts, strict=True)):
                break
        items = [n for ns in nodes for n in ns]
        linked = sum(bool(H.select(n, "a[href]")) for n in items)
        common = Counter(leaf for n in items for leaf in _leaves(n))
        fields = sum(v >= 0.6 * len(items) for v in common.values())
        if linked >= 0.8 * len(items) and fields >= 2 and any(re.search(r"\d", H.clean(n.text())) for n in items):
            found.append((-fields, -len(items), len(path), css, nodes))
    return [(css, nodes) for *_, css, nodes in sorted(found, key=lambda x: x[:4])]


class _Selected:
    """Elements that a selector finds below a scope, looked up once."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, str], list[H.Node]] = {}
        self.places: dict[tuple[int, str], dict[int, int]] = {}

    def below(self, top: H.Node, css: str) -> list[H.Node]:
        key = (id(top), css)
        if key not in self.nodes:
            self.nodes[key] = list(H.select(top, css))
            self.places[key] = {id(x): i for i, x in enumerate(self.nodes[key])}
        return self.nodes[key]

    def place(self, top: H.Node, css: str, node: H.Node) -> int:
        self.below(top, css)
        return self.places[id(top), css].get(id(node), 0)

    def filled(self, recipe: Mapping[str, Any], tops: Sequence[H.Node]) -> int:
        """Scopes in which a plain recipe finds a text."""
        at = recipe.get("index", 0)
        return sum(any(H.clean(x.text()) for x in self.below(top, recipe["css"])[at:][:1]) for top in tops)


def _recipe(path: tuple[str, ...], found: Sequence[tuple[H.Node, H.Node]], selected: _Selected) -> dict[str, Any]:
    """The tail of a path; with the usual place among what it selects where that isn't the first, for elements ``found`` with their scopes."""
    css = " > ".join(path[-2:])
    place = Counter(selected.place(top, css, node) for top, node in found).most_common(1)[0][0]
    return {"css": css} | ({"index": place} if place else {})


def _ranked(scores: Mapping[str, float], recipes: Mapping[str, dict]) -> list[dict]:
    return [recipes[k] for k in sorted(scores, key=lambda k: (-scores[k], k)) if scores[k] > 0]


def _alternatives(tops: Sequence[H.Node], detail: bool, url_of: Sequence[str]) -> dict[str, list[dict]]:
    """For each field, recipes from the best on: by how many of the items' texts look like it, or are labelled so. Those of titles tell how many items they fill."""
    n = len(tops)
    leaves: dict[tuple, list[list[tuple[H.Node, str]]]] = defaultdict(lambda: [[] for _ in range(n)])
    for i, top in enumerate(tops):
        for path, got in _leaves(top).items():
            leaves[path][i] += got
    out: dict[str, list[dict]] = {}
    scores: dict[str, dict[str, float]] = defaultdict(dict)
    recipes: dict[str, dict[str, dict]] = defaultdict(dict)
    selected = _Selected()

    def offer(field: str, recipe: dict, score: float) -> None:
        key = json.dumps(recipe, sort_keys=True)
        if score > scores[field].get(key, 0):
            scores[field][key], recipes[field][key] = score, recipe

    for path, per in leaves.items():
        tag, label = path[-1].split(".")[0], path[-1].partition(".")[2]
        for j in range(max(map(len, per))):
            at = [i for i, x in enumerate(per) if len(x) > j]
            nodes, texts = zip(*(per[i][j] for i in at), strict=True)
            recipe, share = _recipe(path, [(tops[i], node) for i, node in zip(at, nodes, strict=True)], selected), len(at) / n
            filled = [t for t in texts if t]
            varied = len(set(filled)) / max(1, len(filled)) if n > 1 else 1.0
            if tag == "a":
                good = [h for h in (absolute(node.attrs.get("href"), url_of[i]) for i, node in zip(at, nodes, strict=True)) if h]
                if good:
                    numbered = sum(bool(re.search(r"\d", h)) for h in good) / len(good)
                    offer("url", recipe | {"attr": "href"}, share * len(set(good)) / len(good) * (1 + numbered))
            if tag == "img" and any(node.attrs.get("src") for node in nodes):
                offer("image", recipe | {"attr": "src"}, share)
            if not filled:
                continue
            looks = {f: sum(bool(p.search(t)) for t in filled) / len(filled) for f, (p, _) in _LOOKS.items()}
            letters = sum(bool(re.search(r"[^\W\d_]{3}", t)) for t in filled) / len(filled)
            size = sum(map(len, filled)) / len(filled)
            plain = 1 - max(looks["price"] * (size < 40), looks["listed_at"] * (size < 40), looks["listing_type"])
            weight = {"h1": 3, "h2": 2.5, "h3": 2.5, "h4": 2, "a": 1.6, "title": 1.2}.get(tag, 1.0) * (1.3 if "title" in label else 1)
            if 4 <= size <= 300:
                offer("title", recipe, share * letters * plain * weight * (0.4 + 0.6 * varied))
            if size > 60 and tag not in ("a", "h1", "h2", "h3"):
                offer("description", recipe, share * min(size, 1000) / 1000)
            for field, (_, words) in _LOOKS.items():
                named = bool(label and words.search(label))
                if (looks[field] >= 0.5 and size < 120) or (named and share >= 0.3):
                    offer(field, recipe, share * (looks[field] + 1.5 * named))
            typed = sum(bool(_TYPE.search(t)) for t in filled) / len(filled)
            if typed >= 0.5:  # the wording inside a longer text
                offer("listing_type", recipe | {"regex": f"({_TYPE.pattern})"}, share * typed * 0.5)
            # Rows of a label and its value inside one kind of element: all such elements are tried, in any place.
            pairs = [m for t in texts if (m := re.match(r"\s*([^:：]{2,24})[:：]\s*(\S.*)$", t))]
            for field, (_, words) in _LOOKS.items():
                hits = [m for m in pairs if words.search(m[1])]
                if hits and len(hits) >= 0.5 * len(at):
                    name = re.escape(Counter(m[1].strip() for m in hits).most_common(1)[0][0]).replace(r"\ ", " ")
                    offer(field, {"css": recipe["css"], "regex": rf"{name}\s*[:：]\s*(.+)"}, 2.5 * len(hits) / n)
    for field, found in scores.items():
        out[field] = _ranked(found, recipes[field])
    out["title"] = [r | {"filled": selected.filled(r, tops)} for r in out.get("title", [])]
    if detail:
        out["url"] = [{"document_url": True}]
    return out


def propose(pages: Sequence[R.Page], advert_links: int = 3) -> dict[str, Any]:
    """A proposal for pages of one design: kind, ranked item selectors with ranked recipes of each, and ranked recipes of the whole page."""
    blocks = []
    for css, nodes in _blocks(pages):
        tops = [n for ns in nodes for n in ns]
        urls = [p.url for p, ns in zip(pages, nodes, strict=True) for _ in ns]
        fields = _alternatives(tops, False, urls)
        if fields.get("url") and fields.get("title") and (fields.get("price") or fields.get("area") or fields.get("listing_type")):
            blocks.append({"css": css, "fields": fields})
    whole = _alternatives([p.body for p in pages], True, [p.url for p in pages])
    kind = "LIST" if blocks else "DETAIL" if whole.get("title") and whole.get("price") else "OTHER"
    return {"kind": kind, "blocks": blocks, "whole": whole}


def template(proposal: Mapping[str, Any], chosen: Mapping[str, Any]) -> dict[str, Any]:
    """The action of a template node from a proposal and what its repairs have chosen: block, place of each field's recipe (None: dropped), vocabulary."""
    if proposal["kind"] == "OTHER":
        return {"page_kind": "OTHER", "fields": {}}
    block = proposal["blocks"][chosen.get("block", 0)] if proposal["kind"] == "LIST" else None
    fields = block["fields"] if block else proposal["whole"]
    places = chosen.get("places", {})
    picked = {f: {k: v for k, v in recipes[places.get(f, 0)].items() if k != "filled"} for f, recipes in fields.items() if recipes and places.get(f, 0) is not None and places.get(f, 0) < len(recipes)}
    out: dict[str, Any] = {"page_kind": proposal["kind"], "fields": picked}
    if block:
        out["items"] = {"css": block["css"]}
    if chosen.get("vocab"):
        out["vocab"] = {"listing_type": [{"pattern": p, "value": v} for v, p in _TYPES]}
    return out


def repaired(proposal: Mapping[str, Any], chosen: Mapping[str, Any], report: Mapping[str, Any]) -> dict[str, Any] | None:
    """The choices after a report on the design's samples; None where nothing is left to try.

    Report: taken (share of the samples), items, drafts, problems (texts), empty_fields (of all samples), vocab_misses.
    """
    out = {"block": chosen.get("block", 0), "places": dict(chosen.get("places", {})), "vocab": chosen.get("vocab", False)}
    text = " ".join(report["problems"])
    changed = False

    fields = proposal["blocks"][out["block"]]["fields"] if proposal["kind"] == "LIST" else proposal["whole"]

    def next_of(field: str) -> None:
        """The next recipe; behind the last one the field is dropped, and then there is no next."""
        nonlocal changed
        at = out["places"].get(field) or 0
        if at < len(fields.get(field, [])):
            out["places"][field] = at + 1
            changed = True

    if ("listing type unknown" in text or report["vocab_misses"]) and not out["vocab"]:
        out["vocab"] = changed = True
    if "no title" in text:
        # A title that no more items have would leave as many without one.
        titles, at = fields.get("title", []), out["places"].get("title") or 0
        have = titles[at].get("filled") if at < len(titles) else None
        if have is None:
            next_of("title")
        elif (better := next((j for j in range(at + 1, len(titles)) if titles[j]["filled"] > have), None)) is not None:
            out["places"]["title"], changed = better, True
    if "identity" in text or "no external id" in text:
        next_of("url")
    for field in report["empty_fields"]:
        if field not in ("title", "url") and out["places"].get(field, 0) is not None:
            next_of(field)
    if report["price_elsewhere"]:
        next_of("price")
    if not changed and proposal["kind"] == "LIST" and out["block"] + 1 < len(proposal["blocks"]):
        out, changed = {"block": out["block"] + 1, "places": {}, "vocab": out["vocab"]}, True
    return out if changed else None


def _samples(pages: DataFrame, designs: DataFrame, k: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``k`` pages of each design, at even places of the order of ids: leader, id, url, html."""
    chosen = spread(designs.select("leader", F.col(id_col).alias("id")), ["leader"], ["id"], k)
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).join(chosen, "id")


def _reports(samples: DataFrame, graph: R.Graph, identity: R.Identity | None, options: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """What the extraction says of each design's samples: a row a design, of samples only."""
    got = R.extract_pages(samples, graph, id_col="key", identity=identity, **options).join(samples.select("key", "leader"), "key")
    # Problems of a page that no template takes have the items' own in their lines.
    rows = got.groupBy("leader").agg(
        F.count(F.lit(1)).alias("pages"), F.count("page_kind").alias("taken"), F.sum("items").alias("items"), F.sum(F.size("drafts")).alias("drafts"), F.flatten(F.collect_list("problems")).alias("problems"),
        F.collect_list("empty_fields").alias("empty"), F.flatten(F.collect_list(F.coalesce("vocab_misses", F.array().cast("array<string>")))).alias("misses"),
        F.flatten(F.collect_list(F.transform("drafts", lambda d: F.coalesce(d["price_source"], F.lit(""))))).alias("sources"), F.max("template").alias("template"),
        F.flatten(F.collect_list(F.transform("drafts", lambda d: F.struct(d["external_id"].alias("id"), F.col("key").alias("page"))))).alias("ids"),
    ).collect()
    out = {}
    for r in rows:
        empty = set(r.empty[0]) if r.empty else set()
        for e in r.empty[1:]:
            empty &= set(e)
        owners = defaultdict(set)
        for x in r.ids:
            owners[x.id].add(x.page)
        out[r.leader] = {
            "pages": r.pages, "taken": r.taken / r.pages, "items": r["items"], "drafts": r.drafts, "problems": list(r.problems), "empty_fields": sorted(empty), "vocab_misses": list(r.misses), "template": r.template,
            "price_elsewhere": bool(r.sources) and "field" not in r.sources and "title" not in r.sources and "field_fulltext" in r.sources, "shared_ids": sum(len(p) > 1 for p in owners.values()),
        }
    return out


def _faults(kind: str, name: str, report: Mapping[str, Any] | None, limits: TemplateLimits) -> list[str]:
    """Why a template isn't accepted."""
    if report is None or report["taken"] < limits.taken:
        return ["taken on too few samples"]
    out = [] if report["template"] == name else [f"{report['template']} wins"]
    if kind == "OTHER":
        return out
    if kind == "LIST" and report["items"] < 2 * report["taken"] * report["pages"]:
        out.append("fewer than two items a page")
    if report["drafts"] < limits.valid * report["items"] or not report["drafts"]:
        out.append("too few items are valid")
    if any("identity" in p for p in report["problems"]):
        out.append("identity")
    if kind == "DETAIL" and report["shared_ids"]:
        out.append("pages share an identity")
    if report["price_elsewhere"]:
        out.append("the price is elsewhere")
    return out + [f"{f} is always empty" for f in report["empty_fields"]]


def _tried(proposals: DataFrame, told: Sequence[tuple[str, str, str | None]] | None) -> list[Row]:
    """leader, kind, chosen and template (JSON; null where nothing is left to try) of designs: their first choices, or those after reports ``told`` (leader, chosen, report)."""
    spark = proposals.sparkSession
    asked = proposals.select("*", F.lit("{}").alias("chosen"), F.lit(None).cast("string").alias("report")) if told is None else proposals.join(spark.createDataFrame(told, "leader string, chosen string, report string"), "leader")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for leader, proposal, chosen, report in zip(batch["leader"], batch["proposal"], batch["chosen"], batch["report"], strict=True):
                found, now = json.loads(proposal), json.loads(chosen)
                now = repaired(found, now, json.loads(report)) if report else now
                made = None if now is None else json.dumps(template(found, now), ensure_ascii=False)
                out.append((leader, found["kind"], json.dumps(now), made))
            yield pd.DataFrame(out, columns=["leader", "kind", "chosen", "template"])

    return asked.select("leader", "proposal", "chosen", "report").mapInPandas(run, "leader string, kind string, chosen string, template string").collect()


def induce_templates(pages: DataFrame, graph: R.Graph, *, gold: DataFrame | None = None, identity: R.Identity | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: TemplateLimits = TemplateLimits(), **options: Any) -> tuple[R.Graph, list[dict[str, Any]]]:
    """The graph with templates for the designs that it doesn't read, and a report on each design: leader, pages, kind, attempts, accepted, problems.

    Ids of pages must be unique. A page is read where a template takes it. With ``gold`` (as in ``rules.gold_rate``) no new template may lower the share of exact gold answers. Designs are
    tried ``AT_ONCE`` after the other, those of most pages first, beside the templates accepted before them. Their templates and reports reach the driver, where graphs are; sample pages
    and proposals stay in tasks. An empty table, and one that is read whole, changes nothing.
    """
    spark = pages.sparkSession
    state: dict[str, dict[str, Any]] = {}

    def with_templates(leaders: Sequence[str]) -> R.Graph:
        last = max((e.priority for e in graph.edges), default=0)
        nodes = [R.Rule(state[x]["name"], "TEMPLATE", state[x]["template"], "INDUCED") for x in leaders]
        edges = [R.Edge(R.ROOT, state[x]["name"], {"type": "template_fp", "fingerprint": x, "max_distance": limits.distance}, last + 1 + i) for i, x in enumerate(leaders)]
        return graph.revised(add=nodes, link=edges)

    with stage(spark) as work:
        unread = R.extract_pages(pages, graph, id_col=id_col, url_col=url_col, html_col=html_col, identity=identity, **options).where("page_kind is null").select(F.col(id_col).alias("id"), "fingerprint")
        unread = work.store(unread, "unread")
        leaders = cluster_designs(unread.withColumn("position", F.col("id")), most=limits.distance)
        designs = work.store(unread.join(leaders, "fingerprint").select(F.col("id").alias(id_col), "leader"), "designs")
        sizes = designs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
        sizes = work.store(sizes if limits.designs is None else sizes.orderBy(F.desc("n"), "leader").limit(limits.designs), "sizes")
        samples = _samples(pages, designs.join(sizes.select("leader"), "leader"), limits.samples, id_col, url_col, html_col)
        samples = samples.withColumn("key", F.concat_ws(":", "leader", F.col("id").cast("string"))).drop("id").join(sizes, "leader")
        samples = work.store(samples.repartitionByRange(F.desc("n"), "leader").sortWithinPartitions(F.desc("n"), "leader"), "samples")  # in order, so that a piece reads its own

        def proposed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("key")
            found = propose([R.Page(u or "", h or "") for u, h in zip(group["url"], group["html"], strict=True)], limits.advert_links)
            return pd.DataFrame([(group["leader"].iloc[0], json.dumps(found, ensure_ascii=False))], columns=["leader", "proposal"])

        def try_designs(piece: Sequence[Row], work: Stage) -> None:
            """State of the piece's designs, after all that can be tried."""
            n, x = F.col("n"), F.col("leader")
            first, last = piece[0], piece[-1]
            within = (n < first.n) & (n > last.n) | (n == first.n) & (x >= first.leader) & ((n > last.n) | (x <= last.leader)) | (n == last.n) & (x <= last.leader) & ((n < first.n) | (x >= first.leader))
            own_samples = samples.where(within)
            proposals = work.store(own_samples.groupBy("leader").applyInPandas(proposed, "leader string, proposal string"), "proposals")
            before = [x for x in state if not state[x]["faults"]]
            for r in piece:
                state[r.leader] = {"name": f"tpl.v{graph.version + 1}.{len(state) + 1}", "pages": r.n, "attempts": 0, "faults": ["not tried"]}
            made = _tried(proposals, None)
            while made:
                for r in made:
                    state[r.leader] |= {"kind": r.kind, "chosen": r.chosen, "template": json.loads(r.template)}
                open_ = [r.leader for r in piece if r.leader in {m.leader for m in made}]
                told = _reports(own_samples.join(F.broadcast(spark.createDataFrame([(x,) for x in open_], "leader string")), "leader"), with_templates([*before, *open_]), identity, options)
                again = []
                for x in open_:
                    own = state[x]
                    own["attempts"] += 1
                    own["faults"] = _faults(own["kind"], own["name"], told.get(x), limits)
                    if own["faults"] and x in told and (limits.repairs is None or own["attempts"] <= limits.repairs):
                        again.append((x, own["chosen"], json.dumps(told[x], ensure_ascii=False)))
                made = [r for r in _tried(proposals, again) if r.template is not None] if again else []

        rows = iter(sizes.orderBy(F.desc("n"), "leader").toLocalIterator())
        while piece := list(islice(rows, AT_ONCE)):
            with stage(spark) as own:
                try_designs(piece, own)
        good = [x for x in state if not state[x]["faults"]]
        if gold is not None and good:
            rate = lambda g: R.gold_rate(R.extract_pages(pages.join(gold.select(id_col).distinct(), id_col), g, id_col=id_col, url_col=url_col, html_col=html_col, identity=identity, **options), gold, id_col).first()["rate"]
            if rate(with_templates(good)) < (before := rate(graph)):
                # One by one, so that only what lowers the rate goes.
                kept: list[str] = []
                for x in good:
                    now = rate(with_templates([*kept, x]))
                    if now >= before:
                        kept, before = [*kept, x], now
                    else:
                        state[x]["faults"] = ["the gold rate falls"]
                good = kept
        out = with_templates(good) if good else graph
    taken = set(good)
    reports = [{"leader": x, "pages": s["pages"], "kind": s["kind"], "attempts": s["attempts"], "accepted": x in taken, "problems": "; ".join(s["faults"])} for x, s in state.items()]
    return out, reports
