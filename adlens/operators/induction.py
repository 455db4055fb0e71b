"""Rules made from what the present rules miss: routes for URLs (here), and designs of pages that no template reads.

``induce_routes`` proposes, validates and appends until a round adds nothing. A proposal is a URL's own pattern at one of four widths. All
that follows works on misses grouped by their patterns, so its size is that of the site's URL forms, not of its URLs:

* of each pattern the share of all URLs and of all URL shapes that it takes is counted, and patterns that reach too far are out;
* a greedy weighted cover picks the pattern of most misses that are left, again and again. A pattern that is the best of each group
  that it covers would be picked with its present gain whatever else is picked before, so all such are picked in one round.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..sources.staging import Stage, delete, stage
from . import rules as R

#: Fixed: characters that a pattern escapes, segments that it takes as any text (from this length), and what may follow a path.
_SPECIAL, LONG_SEGMENT, _END = r"([.+*?()|{}\[\]^$\\])", 16, r"/?(?:[?#]|$)"
WIDTHS = ("host and path", "domain and path", "path", "domain and first segment")


@dataclass(frozen=True)
class RouteLimits:
    """Most shares of URLs and of shapes (from ``least_shapes`` on) that a rule may take, fewest misses that are worth a rule, rules a round (None: all)."""

    share: float = 0.9
    reach: float = 0.25
    least_shapes: int = 20
    least_misses: int = 1
    rules: int | None = None


#: Rules that are tried on the misses at once: what is broadcast is bounded, and all rules come to their turn.
AT_ONCE = 5000


def url_patterns(url: Column) -> Column:
    """An array of the URL's patterns, by ``WIDTHS``; null where there is no host. Numbers and long segments stand for any."""
    escaped = lambda c: F.regexp_replace(c, _SPECIAL, r"\\$1")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped(path), r"/+$", ""), rf"[^/]{{{LONG_SEGMENT},}}", "[^/]+"), r"\d+", r"\\d+")
    domain = escaped(F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1))
    first = F.regexp_extract(form, "^(/[^/]*)/", 1)
    head = F.lit("^[a-z]+://")
    sub = F.lit(r"(?:[^/?#]+\.)?")
    return F.when(host != "", F.array(
        F.concat(head, escaped(host), form, F.lit(_END)), F.concat(head, sub, domain, form, F.lit(_END)), F.concat(head, F.lit("[^/?#]+"), form, F.lit(_END)), F.concat(head, sub, domain, first, F.lit("/")),
    ))


def pattern_reach(universe: DataFrame, url: str, limits: RouteLimits) -> DataFrame:
    """Patterns of the universe's URLs that don't take too much of it: pattern, urls, shapes."""
    named = universe.select(url_patterns(F.col(url)).alias("patterns"), P.url_shape(F.col(url)).alias("shape"))
    forms = named.groupBy("patterns", "shape").agg(F.count(F.lit(1)).alias("n"))  # as many rows as URL forms
    by_shape = forms.select(F.explode("patterns").alias("pattern"), "shape", "n").groupBy("pattern", "shape").agg(F.sum("n").alias("n"))
    taken = by_shape.groupBy("pattern").agg(F.sum("n").alias("urls"), F.count(F.lit(1)).alias("shapes"))
    total = named.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("shape").alias("kinds"))
    fair = (F.col("urls") < limits.share * F.col("all")) & ((F.col("kinds") < limits.least_shapes) | (F.col("shapes") <= limits.reach * F.col("kinds")))
    return taken.crossJoin(F.broadcast(total)).where(fair).select("pattern", "urls", "shapes")  # total is one row


def cover(groups: DataFrame, fair: DataFrame, work: Stage, least: int = 1) -> DataFrame:
    """Greedy cover of ``groups`` (patterns, n) by patterns of ``fair``: pattern, width, gain, in the order of picking by gain, width, pattern."""
    edges = groups.select(F.xxhash64("patterns").alias("g"), "n", F.posexplode("patterns").alias("width", "pattern")).join(fair.select("pattern"), "pattern")
    left, picks = work.store(edges, "edges"), []
    while True:
        gain = left.groupBy("pattern").agg(F.sum("n").alias("gain"), F.min("width").alias("width"), F.count(F.lit(1)).alias("groups")).where(F.col("gain") >= least)
        rank = F.struct(-F.col("gain"), "width", "pattern")
        own = left.select("g", "n", "pattern").join(gain, "pattern")
        best = own.groupBy("g").agg(F.min(rank).alias("best"))
        wins = best.groupBy("best.pattern").agg(F.count(F.lit(1)).alias("won"))
        picked = work.store(gain.join(wins, "pattern").where("won = groups").select("pattern", "width", "gain"), "picked")
        if picked.isEmpty():
            break
        picks.append(picked)
        covered = left.join(picked.select("pattern"), "pattern").select("g").distinct()
        left = work.store(left.join(covered, "g", "left_anti"), "edges")
    out = picks[0] if picks else picked
    for more in picks[1:]:
        out = out.unionAll(more)
    return out


def decided(pattern: Column) -> Column:
    """Decision and page kind of a pattern: numbered pages are adverts, others lists."""
    return F.struct(F.lit("FETCH").alias("decision"), F.when(F.regexp_replace(pattern, r"\(\?:\[\?#\]\|\$\)$", "").contains(r"\d+"), "DETAIL").otherwise("LIST").alias("page_kind"))


def _missed(routed: DataFrame) -> DataFrame:
    return routed.where("decision = 'UNROUTED'").select("url")


def _in_pieces(rows: Iterable[Row], n: int) -> Iterator[list[Row]]:
    rows = iter(rows)
    while piece := list(islice(rows, n)):
        yield piece


def induce_routes(universe: DataFrame, graph: R.Graph, *, url: str = "url", limits: RouteLimits = RouteLimits(), rounds: int | None = None) -> tuple[R.Graph, list[dict]]:
    """The graph with routes for the URLs that it misses, and these rules as dicts: round, key, pattern, width, gain, decision, page_kind.

    Rules go behind the present ones, in the order of picking, as induced ones. A rule that is no miss's first match is dropped, and not proposed again. It ends when
    no miss is left, or when none of the misses' other patterns is fair, unless ``limits.rules`` or ``rounds`` end it before. Rules reach the driver, where graphs are, and are tried
    ``AT_ONCE`` after the other on what those before them leave. URLs without a host are never routed.
    """
    spark = universe.sparkSession
    made: list[dict] = []
    with stage(spark) as work:
        fair = work.store(pattern_reach(universe, url, limits), "fair")
        # Stored, so that rules are tried on the misses in one pass of Python, not behind another; what a round's rules don't take is missed by the next graph.
        missed = work.store(_missed(R.route_urls(universe.select(F.col(url).alias("url")), graph, key="url")), "missed")
        for turn in count(1) if rounds is None else range(1, rounds + 1):
            groups = work.store(missed.select(url_patterns(F.col("url")).alias("patterns")).where("patterns is not null").groupBy("patterns").agg(F.count(F.lit(1)).alias("n")), "misses")
            found = cover(groups, fair, work, limits.least_misses).select("pattern", "width", "gain", decided(F.col("pattern")).alias("d"))
            found = work.store(found if limits.rules is None else found.orderBy(F.desc("gain"), "width", "pattern").limit(limits.rules), "rules")
            last, i, nodes, edges = max((e.priority for e in graph.edges), default=0), 0, [], []
            for nth, rows in enumerate(_in_pieces(found.orderBy(F.desc("gain"), "width", "pattern").toLocalIterator(), AT_ONCE)):
                names = [f"nav.v{graph.version + 1}.{i + k + 1}" for k in range(len(rows))]
                new = [R.Rule(k, "ROUTE", {"decision": r.d.decision, "page_kind": r.d.page_kind, "gain": r.gain}, "INDUCED") for k, r in zip(names, rows, strict=True)]
                links = [R.Edge(R.ROOT, k, {"type": "url_regex", "pattern": r.pattern}, last + 1 + i + j) for j, (k, r) in enumerate(zip(names, rows, strict=True))]
                tried = work.store(R.route_urls(missed, R.Graph(tuple(new), tuple(links)), key="url").select("url", "decision", "node"), "tried")  # no rule of the graph takes them
                if nth:
                    delete(spark, work.paths.pop(-2))  # what the rules before left, which isn't read any more
                winners = {r[0] for r in tried.select("node").distinct().collect()}  # rules, not URLs
                nodes += [x for x in new if x.key in winners]
                edges += [x for x in links if x.end in winners]
                made += [{"round": turn, "key": k, "pattern": r.pattern, "width": WIDTHS[r.width], "gain": r.gain, "decision": r.d.decision, "page_kind": r.d.page_kind} for k, r in zip(names, rows, strict=True) if k in winners]
                missed, i = _missed(tried), i + len(rows)
            if not i:
                break
            if nodes:
                graph = graph.revised(add=nodes, link=edges)
            fair = work.store(fair.join(found.select("pattern"), "pattern", "left_anti"), "fair")
    return graph, made


# Designs ---------------------------------------------------------------------------------------------------------------

#: Bits in a segment of a fingerprint, and the distance up to which two of ten bits' distance agree in one of four segments.
_SEGMENTS, _WIDTH = 4, 16


def _near_pairs(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, d) of nodes (o, fp) within ``most`` bits, a before b in o; each pair once.

    Of four segments of 16 bits one differs by at most ``most // 4`` = 2 bits, so that both are one bit at most from a common key. A pair is
    told at its first such segment and at one of its common keys, before it leaves the join.
    """
    if not 0 <= most < 12:
        raise ValueError("distances from 0 to 11 bits meet at keys of one bit's distance")
    part = lambda fp, s: F.shiftrightunsigned(fp, F.lit(s * _WIDTH)).bitwiseAND(0xFFFF) if isinstance(s, Column) else F.shiftrightunsigned(fp, s * _WIDTH).bitwiseAND(0xFFFF)
    keys = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), part(F.col("fp"), s).cast("int").alias("p")) for s in range(_SEGMENTS)))).alias("k")
    masks = F.array(*(F.lit(0 if i < 0 else 1 << i) for i in range(-1, _WIDTH)))
    spread = nodes.select("o", "fp", keys).select("o", "fp", "k.s", "k.p", F.explode(masks).alias("m")).select("o", "fp", (F.col("p").bitwiseXOR(F.col("m")) * 4 + F.col("s")).alias("key"), "s", "m")
    left, right = spread.alias("l"), spread.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    here = [F.bit_count(F.shiftrightunsigned(x, s * _WIDTH).bitwiseAND(0xFFFF)) for s in range(_SEGMENTS)]
    first = F.when(here[0] <= 2, 0).when(here[1] <= 2, 1).when(here[2] <= 2, 2).otherwise(3)
    # Of two common keys of a pair that differs in the segment by bits i < j the one that a reaches by i; by one bit, or none, a's own.
    apart = F.col("l.m").bitwiseXOR(F.col("r.m"))
    chosen = F.when(F.col("l.m") == 0, F.bit_count(F.col("r.m")) <= 1).otherwise((F.col("l.m") < F.col("r.m")) & (F.bit_count(apart) == 2))
    hit = left.join(right, F.col("l.key") == F.col("r.key")).where((F.col("l.o") < F.col("r.o")) & (F.bit_count(x) <= most) & (first == F.col("l.s")) & chosen)
    return hit.select(F.col("l.o").alias("a"), F.col("r.o").alias("b"), F.bit_count(x).alias("d"))


def cluster_designs(fingerprints: DataFrame, known: DataFrame | None = None, *, most: int = 10, fp: str = "fingerprint", order: str = "position") -> DataFrame:
    """(fingerprint, leader) of each distinct fingerprint, as if taken one after the other in ``order``.

    Each goes to the nearest leader within ``most`` bits, the earliest of equally near ones, or becomes a leader itself; those of ``known`` (same columns) are leaders from the start. A
    repeated fingerprint counts at its first place, ties of places go by text. What isn't 16 hexadecimal digits is its own leader. Nothing is collected: pairs within reach
    are found once, then in each round those that no undecided earlier one reaches become leaders, and what they reach is decided too.
    """
    spark = fingerprints.sparkSession
    number = lambda c: F.when(c.rlike("^[0-9A-Fa-f]{16}$"), F.conv(c, 16, -10).cast("long"))
    new = fingerprints.select(F.col(fp).alias("text"), F.struct(F.lit(1).alias("new"), F.col(order).alias("at"), F.col(fp).alias("text")).alias("place"))
    if known is not None:
        new = new.unionAll(known.select(F.col(fp).alias("text"), F.struct(F.lit(0).alias("new"), F.col(order).alias("at"), F.col(fp).alias("text")).alias("place")))
    work = Stage(spark)
    firsts = new.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("place").alias("o"), F.max("place.new").alias("asked")).withColumn("fp", number(F.col("text")))
    nodes = work.store(firsts, "designs")
    pairs = work.store(_near_pairs(nodes.where("fp is not null").select("o", "fp"), most), "pairs")
    leaders = nodes.where("o.new = 0").select("o")
    leaders = work.store(leaders.unionAll(nodes.where("o.new = 1 and fp is null").select("o")), "leaders")
    found = [leaders]
    open_ = nodes.where("o.new = 1 and fp is not null").select("o")
    live = pairs
    fresh = leaders
    while True:
        reached = live.join(fresh.withColumnRenamed("o", "a"), "a", "left_semi").select(F.col("b").alias("o")).distinct()
        open_ = work.store(open_.join(reached, "o", "left_anti").join(fresh, "o", "left_anti"), "open")
        if open_.isEmpty():
            break
        # Pairs whose earlier one isn't undecided hold nothing back.
        live = work.store(live.join(open_.withColumnRenamed("o", "a"), "a", "left_semi").join(open_.withColumnRenamed("o", "b"), "b", "left_semi"), "live")
        fresh = work.store(open_.join(live.select(F.col("b").alias("o")).distinct(), "o", "left_anti"), "fresh")
        found.append(fresh)
    everyone = found[0]
    for more in found[1:]:
        everyone = everyone.unionAll(more)
    nearest = pairs.join(everyone.withColumnRenamed("o", "a"), "a", "left_semi").groupBy("b").agg(F.min(F.struct("d", "a")).alias("n"))
    lead = everyone.select(F.col("o").alias("b"), F.lit(True).alias("own"))
    joined = nodes.where("asked = 1").join(nearest, nodes["o"] == nearest["b"], "left").drop("b").join(lead, nodes["o"] == lead["b"], "left")
    out = work.store(joined.select(F.col("text").alias(fp), F.when(F.col("own"), F.col("text")).otherwise(F.col("n.a.text")).alias("leader")), "clusters")
    work.drop(keep=1)
    return out
