"""What a caller may ask of stored repositories: bounds, guards, and operations that need more than one operator.

Bounds are checked in one place, before any plan is made. Refusals are exceptions that say what was asked and what is allowed.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scoring import SEVERITIES
from lodestar.operators import cochange, debt, graph, impact, listing, risk

#: Least and most of what a request may name.
BOUNDS = {
    "graph.limit": (1, 5000), "search.limit": (1, 200), "neighbours.limit": (1, 1000), "impact.limit": (1, 1000), "risk.limit": (1, 200), "cochange.min_commits": (1, 1000), "cochange.limit": (1, 1000),
    "debt.limit": (1, 2000), "debt.offset": (0, None), "debt.min_confidence": (0.0, 1.0), "depth": (1, graph.MAX_DEPTH),
}
EXPLAINED, KEPT = 25, 64


class Refused(ValueError):
    """A request that its own terms rule out."""


class NotReady(RuntimeError):
    """The repository is not in the state that the request needs."""


def bounded(what: str, value):
    low, high = BOUNDS[what]
    if value < low or high is not None and value > high:
        raise Refused(f"{what} must be {'at least ' + str(low) if high is None else f'between {low} and {high}'}, not {value}")
    return value


def graph_page(nodes: DataFrame, edges: DataFrame, view: str = "files", limit: int = 500) -> tuple[DataFrame, bool]:
    """The files or calls view, as far as the limit goes, and whether there is more."""
    if view not in ("files", "calls"):
        raise Refused(f"view must be files or calls, not {view}")
    rows = graph.files_view(nodes, edges) if view == "files" else graph.calls_view(nodes, edges)
    return graph.truncated(rows.orderBy("src", "dst"), bounded("graph.limit", limit))


def search(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    if not query:
        raise Refused("a search needs a character at least")
    return graph.search_nodes(nodes, query, bounded("search.limit", limit))


def reached(nodes: DataFrame, edges: DataFrame, key: str, forward: bool, depth: int = 2, limit: int = 200) -> tuple[DataFrame, bool]:
    """Dependencies (forward) or dependents of a node that is there, nearest first, and whether there are more."""
    root = graph.get_node(nodes, key).select(F.col("key").alias("node"))
    walk = graph.dependencies if forward else graph.dependents
    return graph.truncated(walk(edges, root, bounded("depth", depth)).orderBy("hops", F.desc("confidence"), "node"), bounded("neighbours.limit", limit))


def impact_page(nodes: DataFrame, edges: DataFrame, key: str, depth: int = impact.DEPTH, decay: float = impact.DECAY, limit: int = 200) -> tuple[DataFrame, bool]:
    root = graph.get_node(nodes, key).select(F.col("key").alias("node"))
    return graph.truncated(impact.impact(edges, root, bounded("depth", depth), decay), bounded("impact.limit", limit))


def risk_page(scored: DataFrame, limit: int = 20) -> DataFrame:
    return risk.rank(scored, bounded("risk.limit", limit))


def cochange_page(pairs: DataFrame, path: str | None = None, min_commits: int = 2, limit: int = 100) -> DataFrame:
    return cochange.coupled(pairs, path, bounded("cochange.min_commits", min_commits), bounded("cochange.limit", limit))


def last_status(jobs: DataFrame, repo: str) -> str | None:
    row = listing.latest_job(jobs.where(F.col("repo").cast("string") == repo)).select("status").first()
    return row and row.status


def debt_page(jobs: DataFrame, repo: str, detectors: dict[str, Callable[[], DataFrame]], kinds: list[str] | None = None, min_severity: str | None = None, min_confidence: float = 0.0, limit: int = 200, offset: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """A page of the findings of a repository whose last parse is complete, and why detectors failed. Only the kinds asked for run."""
    status = last_status(jobs, repo)
    if status != "complete":
        raise NotReady(f"repository {repo} is {status or 'not parsed'}: there is nothing to scan")
    unknown = sorted(set(kinds or ()) - set(detectors))
    if unknown:
        raise Refused(f"unknown kinds {', '.join(unknown)}; known: {', '.join(sorted(detectors))}")
    if min_severity is not None and min_severity not in SEVERITIES:
        raise Refused(f"unknown severity {min_severity}; known: {', '.join(SEVERITIES)}")
    for what, value in (("debt.min_confidence", min_confidence), ("debt.limit", limit), ("debt.offset", offset)):
        bounded(what, value)
    found, _, failed = debt.run_detectors(detectors, kinds)
    if found is None:
        raise NotReady(f"no detector ran: {failed}")
    return listing.page(debt.ordered(debt.filter_findings(found, None, min_severity, min_confidence)), limit, offset), failed


def reparse_source(repositories: DataFrame, repo: str) -> str:
    """Where to fetch a repository again: only one that came from an address can be. repositories: (repo, url)."""
    row = repositories.where(F.col("repo").cast("string") == repo).select("url").first()
    if row is None:
        raise graph.NodeNotFound(repo)
    if not row.url:
        raise NotReady(f"repository {repo} was uploaded and has no address to fetch it from")
    return row.url


@dataclass(frozen=True)
class Explanation:
    key: str
    text: str
    affected: int
    explained: int
    cached: bool


class Explainer:
    """Explains blast radii in prose through a chat function, and keeps the last `size` answers by (repo, key, depth, commit)."""

    def __init__(self, chat: Callable[[str], str], size: int = KEPT):
        self.chat, self.size, self.held = chat, size, OrderedDict()

    def explain(self, repo: str, key: str, items: DataFrame, depth: int = impact.DEPTH, commit: str | None = None) -> Explanation:
        """items: impact() of the key with `description` and `label`. An empty radius needs no chat; an empty answer isn't kept."""
        affected = items.count()
        if not affected:
            return Explanation(key, f"A change of `{key}` stays where it is: no node known here leads to it in {depth} hops. Code outside, dynamic calls and calls left unresolved are not part of this.", 0, 0, False)
        at, explained = (repo, key, depth, commit), min(affected, EXPLAINED)
        if at in self.held:
            self.held.move_to_end(at)
            return Explanation(key, self.held[at], affected, explained, True)
        text = self.chat(impact.build_prompt(key, items, EXPLAINED, depth))
        if text:
            self.held[at] = text
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return Explanation(key, text or "The chat gave no explanation.", affected, explained, False)
