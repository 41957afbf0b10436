"""Security events within messages: the facts nearest to each instrument, found over the tree of a message's sequences.

Facts are reduced to the best one per attribute and sequence occurrence; these go up the tree to all that is above them, and each event
asks its own place, the places above it, the one beside it and the root. Work grows with facts and events, not with their
product. A message is whole in a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .capture import Rules, Values, _plain
from .parse import _names, parts

# Which entities and columns tell of an attribute, and the message types of each kind of event.
#: attribute -> (condition on entity and column, preference) in falling preference.
LOOKUPS = {
    "amount": [(lambda e, c: "transaction" in e and c == "amount", 2), (lambda e, c: c == "amount", 1)],
    "quantity": [(lambda e, c: e == "settlement_quantity" and c == "quantity", 2), (lambda e, c: c == "quantity", 1)],
    "safekeeping_account": [(lambda e, c: "safekeep" in c, 3), (lambda e, c: e == "settlement_account" and "account" in c, 2), (lambda e, c: c == "account" and ("account" in e or "party" in e), 1)],
    "party_bic": [(lambda e, c: e == "settlement_party" and c == "party", 2), (lambda e, c: c == "party", 1)],
    "status": [(lambda e, c: c == "status_code" and "status" in e, 2), (lambda e, c: c == "status_code", 1)],
    "transaction_ref": [(lambda e, c: e == "mt537_transaction_link" and c == "linked_reference", 2)],
    "sett": [(lambda e, c: (e, c) == DATE, 1)],
    "sender": [(lambda e, c: e == "mt537_statement" and c == "sender_reference", 1)],
}
#: The pair of dates, which come from fields.
DATE = ("#field", "#date")
SETTLEMENT = ("MT536", "MT537", "MT538", *(f"MT54{i}" for i in range(9)))
TRADE = ("MT513", "MT515", "MT517", "MT518")

FOUND = "message_id string, message_type string, row_seq long, isin string, instrument_desc string, " + ", ".join(f"{a} string" for a in LOOKUPS) + ", amount_raw string"

_CODE = re.compile(r"ISIN +[A-Za-z]{2}[A-Za-z0-9]{10}[\x85\u2028\u2029]?\Z")


def ranks(tests: list[tuple], pairs: list[tuple[str, str]]) -> np.ndarray:
    """The preference of each pair of entity and column, 0 where it doesn't tell of the attribute."""
    return np.array([next((p for f, p in tests if f(e or "", c or "")), 0) for e, c in pairs], np.int64)


def event_kind(message_type: str | None) -> str:
    """The kind of events that a type tells of, in whatever case and between whatever spaces it is written."""
    t = (message_type or "").strip(" ").upper()
    return "holding" if t == "MT535" else "settlement" if t in SETTLEMENT else "trade_confirm" if t in TRADE else "other"


def isin_of(blob: str | None) -> tuple[str | None, str | None]:
    """(ISIN, description) of an instrument text: the first line ISIN and a code of two letters and ten letters or digits; the other
    lines, joined."""
    lines = [x for x in (y.strip(" ") for y in re.split("[\n\r]", blob or "")) if x]
    at = next((i for i, x in enumerate(lines) if _CODE.match(x)), None)
    if at is None:
        return None, " ".join(lines) or None
    return re.search(r"[A-Za-z0-9]{12}", lines[at][4:])[0], " ".join(lines[:at] + lines[at + 1 :]) or None


def instruments(texts: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """isin_of each text; those of one or two lines, the first of them the code, by one pattern for all."""
    plain = pc.extract_regex(texts, r"^ISIN +(?P<isin>[A-Za-z]{2}[A-Za-z0-9]{10})(?:\n *(?P<desc>[^\n\r ](?:[^\n\r]*[^\n\r ])?) *)?$")
    isin, desc = pc.struct_field(plain, "isin"), pc.struct_field(plain, "desc")
    desc = pc.if_else(pc.fill_null(pc.equal(desc, ""), True), pa.scalar(None, pa.string()), desc)
    if not (odd := pc.and_(pc.is_null(plain), pc.is_valid(texts))).true_count:
        return isin, desc
    told = [isin_of(t) for t in texts.filter(odd).to_pylist()]
    put = lambda into, i: pc.replace_with_mask(into, odd, pa.array([x[i] for x in told], pa.string()))
    return put(isin, 0), put(desc, 1)


class Tree:
    """The places (message, path) of facts and events and all above them, root left out."""

    def __init__(self, paths: list[str], message: np.ndarray, path: np.ndarray):
        names: dict[str, int] = {"$": 0}
        parent, depth, first = [0], [0], [0]

        def number(p: str) -> int:
            if p not in names:
                above = number(p.rpartition("/")[0]) if "/" in p else 0
                names[p] = len(parent)
                parent.append(above)
                depth.append(depth[above] + 1)
                first.append(first[above] if above else names[p])
            return names[p]

        self.node = np.array([number(p) for p in paths], np.int64)
        parent, self.depths, first = (np.array(x, np.int64) for x in (parent, depth, first))
        occurrences: dict[str, int] = {}
        occurrence = np.zeros(len(parent), np.int64)
        for p, k in names.items():
            if depth[k] == 1:
                found = re.search(r"\[([0-9]+)\]$", p)
                occurrence[k] = occurrences.setdefault(found[1] if found else "", len(occurrences))
        self.n = n = len(parent)
        node = self.node[path]
        codes = ahead = np.unique((message * n + node)[node > 0])
        while len(ahead := ahead[self.depths[ahead % n] > 1]):
            ahead = np.unique(ahead // n * n + parent[ahead % n])
            codes = np.union1d(codes, ahead)
        self.codes, own = codes, codes % n
        self.depth = self.depths[own]
        at = lambda to: np.searchsorted(codes, codes // n * n + to)
        self.parent, self.first = np.where(self.depth > 1, at(parent[own]), -1), at(first[own])
        #: Places of the first level by message and occurrence.
        self.tops = np.flatnonzero(self.depth == 1)
        groups = codes[self.tops] // n * max(len(occurrences), 1) + occurrence[own[self.tops]]
        self.groups, inverse = np.unique(groups, return_inverse=True)
        self.group = np.full(len(codes), -1)
        self.group[self.tops] = inverse

    def place(self, message: np.ndarray, path: np.ndarray) -> np.ndarray:
        """-1 at root."""
        node = self.node[path]
        return np.where(node > 0, np.searchsorted(self.codes, message * self.n + node), -1)


def nearest(tree: Tree, messages: int, fact: tuple[np.ndarray, np.ndarray], order: np.ndarray, rank: np.ndarray, event: tuple[np.ndarray, np.ndarray], free: np.ndarray, name: str) -> np.ndarray:
    """The best fact of each event, or -1. fact, event: (message, place); order: the facts, worst first, by rank and then by what decides
    among those that are equally near; rank: of each fact. Nearer facts of one rank come first: near is one more than the
    leading parts shared with the event's branch, 1 under the same occurrence of another first part, 0 at root."""
    (message, place), (asker, at) = fact, event
    count = np.arange(len(order))
    of = lambda size: np.full(size, -1, np.int64)
    every, root, own = of(messages), of(messages), of(len(tree.codes))
    every[message[order]] = count  # of facts of one place the last, and best, stays
    if name == "sender":
        return np.where(every[asker] >= 0, order[every[asker]], -1) if len(order) else of(len(asker))
    top, inside = order[place[order] < 0], place[order] >= 0
    root[message[top]] = count[~inside]
    own[place[order[inside]]] = count[inside]
    below, beside, deep = own.copy(), of(len(own)), np.flatnonzero(tree.depth > 1)
    for d in range(int(tree.depth.max(initial=0)), 1, -1):
        level = np.flatnonzero(tree.depth == d)
        np.maximum.at(below, tree.parent[level], below[level])
    np.maximum.at(beside, tree.parent[deep], own[deep])
    # Per message and occurrence the best first part, and the best but that one.
    group, best, second = tree.group[tree.tops], of(len(tree.groups)), of(len(tree.groups))
    np.maximum.at(best, group, below[tree.tops])
    holds = (below[tree.tops] == best[group]) & (best[group] >= 0)
    holder = of(len(tree.groups))
    holder[group[holds]] = tree.tops[holds]
    np.maximum.at(second, group[~holds], below[tree.tops[~holds]])

    ranked = np.concatenate([rank[order], [0]])
    score, levels = of(len(asker)), int(tree.depth.max(initial=0)) + 3

    def offer(who: np.ndarray, found: np.ndarray, near: np.ndarray | int) -> None:
        worth = np.where(found >= 0, (ranked[found] * levels + near) * max(len(order), 1) + found, -1)
        score[who] = np.maximum(score[who], worth)

    offer(np.flatnonzero(free), every[asker[free]], 0)
    if name != "sett":
        offer(np.flatnonzero(~free), root[asker[~free]], 0)
    who = np.flatnonzero(at >= 0)
    cell = at[who]
    depth, g = tree.depth[cell], tree.group[tree.first[cell]]
    offer(who, below[cell], depth + 1)
    offer(who, np.where(holder[g] == tree.first[cell], second[g], best[g]), 1)
    low = depth > 1
    offer(who[low], beside[tree.parent[cell[low]]], depth[low])
    while len(who := who[low]):
        cell = tree.parent[cell[low]]
        depth = tree.depth[cell]
        offer(who, own[cell], depth + 1)
        low = depth > 1
    return np.where(score >= 0, order[score % max(len(order), 1)], -1) if len(order) else of(len(asker))


def found_events(ids: pa.Array, kinds: pa.Array, paths: list[str], pairs: list[tuple[str, str]], message: np.ndarray, path: np.ndarray, pair: np.ndarray, row_ord: np.ndarray, value: pa.StringArray, raw: pa.StringArray, types: pa.StringArray) -> pa.RecordBatch:
    """FOUND of some messages (ids, kinds) from their facts, whose pairs say what they are; types: the message type of each fact."""
    has_event = np.array([event_kind(t) != "other" for t in kinds.to_pylist()], bool)
    blob = np.array(["instrument" in (c or "") for _, c in pairs], bool)
    at = np.flatnonzero(blob[pair] & has_event[message]) if len(pairs) else np.zeros(0, np.int64)
    isin, desc = instruments(value.take(pa.array(at)))
    there = isin.is_valid()
    at, isin, desc = at[there.to_numpy(zero_copy_only=False)], isin.filter(there), desc.filter(there)
    alone = np.setdiff1d(np.flatnonzero(has_event), message[at])
    asker = np.concatenate([message[at], alone])
    place_of = np.concatenate([path[at], np.full(len(alone), -1)])
    seq = np.concatenate([row_ord[at], np.zeros(len(alone), np.int64)])
    order = np.lexsort((place_of, seq, asker))
    asker, free = asker[order], place_of[order] < 0
    number = np.arange(len(asker)) - np.searchsorted(asker, asker)
    told, kind = pa.array(order, mask=order >= len(at)), pa.concat_arrays([types.take(pa.array(at)), kinds.take(pa.array(alone))]).take(pa.array(order))
    # Facts have a value; a date field without a date counts as one.
    filled = pc.fill_null(pc.greater(pc.binary_length(value), 0), False).to_numpy(zero_copy_only=False) | np.array([p == DATE for p in pairs], bool)[pair] if len(pairs) else np.zeros(0, bool)
    of_event = np.where(place_of[order] < 0, 0, place_of[order])
    tree = Tree(paths, np.concatenate([message, asker[~free]]), np.concatenate([path, of_event[~free]]))
    cell = tree.place(message, path)
    own = np.full(len(asker), -1)
    own[~free] = tree.place(asker[~free], of_event[~free])
    columns = [ids.take(pa.array(asker)), kind, pa.array(number), isin.take(told), desc.take(told)]
    amount_raw = None
    for name, tests in LOOKUPS.items():
        rank = ranks(tests, pairs)[pair] if len(pairs) else np.zeros(0, np.int64)
        facts = np.flatnonzero((rank > 0) & filled)
        facts = facts[np.lexsort((_ties(message[facts], rank[facts], row_ord[facts], value, raw, facts), -row_ord[facts], rank[facts]))]
        best = nearest(tree, len(ids), (message, cell), facts, rank, (asker, own), free, name)
        take = pa.array(best, mask=best < 0)
        columns.append(value.take(take))
        amount_raw = raw.take(take) if name == "amount" else amount_raw
    return pa.RecordBatch.from_arrays([*columns, amount_raw], _names(FOUND))


def _ties(message: np.ndarray, rank: np.ndarray, row_ord: np.ndarray, value: pa.StringArray, raw: pa.StringArray, facts: np.ndarray) -> np.ndarray:
    """Order by value and raw capture among facts of one field, which are few; 0 elsewhere."""
    order = np.lexsort((row_ord, rank, message))
    same = np.flatnonzero((np.diff(message[order]) == 0) & (np.diff(rank[order]) == 0) & (np.diff(row_ord[order]) == 0))
    out = np.zeros(len(facts), np.int64)
    tied = np.unique(order[np.concatenate([same, same + 1])])
    if len(tied):
        take = pa.array(facts[tied])
        keys = [(v or "", r is not None, r or "") for v, r in zip(value.take(take).to_pylist(), raw.take(take).to_pylist(), strict=True)]
        place = {k: i for i, k in enumerate(sorted(set(keys)))}
        out[tied] = [place[k] for k in keys]
    return out


def _dates(tags: pa.StringArray, qualifier: pa.StringArray) -> np.ndarray:
    """The fields that tell of a settlement date."""
    return np.flatnonzero(pc.and_(pc.fill_null(pc.equal(qualifier, "SETT"), False), pc.starts_with(tags, "98")).to_numpy(zero_copy_only=False))


def _day(values: pa.StringArray) -> pa.StringArray:
    return pc.fill_null(pc.struct_field(pc.extract_regex(values, "(?P<v>[0-9]{8})"), "v"), "")


def events_of(rules: Rules):
    """Rows message_id, message_type, body -> FOUND, from one parse."""
    pairs = [*rules.pairs, DATE]
    told = {i for i, (_, c) in enumerate(pairs[:-1]) if "instrument" in c} | {int(i) for tests in LOOKUPS.values() for i in np.flatnonzero(ranks(tests, pairs[:-1]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            v = Values(part, rules, told)
            dates = _dates(v.cut.tags, v.qualifier)
            closing = [i for i, p in v.walk.problems.items() if p == "mismatched_end"]
            dates = np.setdiff1d(dates, closing)
            of = v.cut.values.take(pa.array(dates))
            message = np.concatenate([v.message, v.cut.message[dates]])
            yield found_events(
                part.column(0), part.column(1), v.paths, pairs, message, np.concatenate([v.path, v.walk.path[dates]]), np.concatenate([v.pair, np.full(len(dates), len(pairs) - 1)]),
                np.concatenate([v.row_ord, v.cut.seq[dates]]), pa.concat_arrays([v.value, _day(of)]), pa.concat_arrays([v.raw, of]), part.column(1).take(pa.array(message)),
            )

    return run


#: Rows of messages (what 0), values (1) and dates (2), for events of tables of values.
ROWS = "message_id string, what int, message_type string, entity string, column string, seq_index string, value string, raw string, row_ord long"


def events_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS, those of a message side by side -> FOUND. The rows of a message are held together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch])
        ids = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        if cut:
            yield _of_rows(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield _of_rows(held)


def _of_rows(table: pa.Table) -> pa.RecordBatch:
    ids, what, kind, entity, column, paths, value, raw, row_ord = (_plain(c) for c in table.columns)
    known = ids.dictionary_encode()
    message, what = known.indices.to_numpy(), what.to_numpy()
    heads, rows = np.flatnonzero(what == 0), np.flatnonzero(what > 0)
    own = np.full(len(known.dictionary), -1)
    own[message[heads[::-1]]] = heads[::-1]
    kinds = kind.take(pa.array(own, mask=own < 0))
    take = pa.array(rows)
    codes: dict[tuple[str, str], int] = {}
    pair = np.array([codes.setdefault(p, len(codes)) for p in zip(entity.take(take).to_pylist(), column.take(take).to_pylist(), strict=True)], np.int64)
    path = paths.take(take).dictionary_encode()
    return found_events(known.dictionary, kinds, path.dictionary.to_pylist(), list(codes), message[rows].astype(np.int64), path.indices.to_numpy().astype(np.int64), pair, row_ord.to_numpy(zero_copy_only=False)[rows].astype(np.int64), value.take(take), raw.take(take), kind.take(take))
