"""Stream state kept for many keys at once, against one key after the other."""

import random

import pandas as pd

from haulmark.streaming import quotes
from haulmark.streaming.quotes import _FIELDS, STATE_TTL_MS

DAY = 24 * 3600 * 1000


class Held:
    def __init__(self):
        self.rows = {}

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value

    def clear(self):
        self.rows = {}

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))


class Handle:
    """State and timers of one group."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Held()

    def getValueState(self, *_):
        return Held()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def batch_of(rows):
    frame = pd.DataFrame(rows)
    return frame.assign(ts=pd.to_datetime(frame["ts"], unit="ms"))


def sent(processor, rows, mark):
    frame = batch_of(rows)
    made = list(processor.handleInputRows((0,), iter([frame.iloc[:3], frame.iloc[3:]]), Clock(mark)))
    return pd.concat(made) if made else pd.DataFrame(columns=["id_email", "reject_reason"])


def test_many_ids_share_a_call_and_a_timer():
    seen, handle = started(quotes.FirstSeen(["id_email", "ts", "reject_reason"], "id_email"))
    first = sent(seen, [{"id_email": i % 50, "ts": DAY + 1000 * (100 - i)} for i in range(100)], 0)
    assert sorted(first["id_email"]) == list(range(50))
    assert set(first["ts"]) == {pd.Timestamp(DAY + 1000 * (100 - i), unit="ms") for i in range(50, 100)}
    assert len(handle.timers) == 1 and len(seen.held.rows) == 50
    # One repeat keeps its id alive; a new id behind the watermark is late.
    again = sent(seen, [{"id_email": 7, "ts": 20 * DAY}, {"id_email": 60, "ts": DAY}, {"id_email": 8, "ts": 19 * DAY}], 15 * DAY)
    assert [(r.id_email, r.reject_reason) for r in again.itertuples()] == [(60, "late")]
    list(seen.handleExpiredTimer((0,), Clock(DAY + STATE_TTL_MS + DAY), None))
    assert sorted(seen.held.rows) == [("60",), ("7",), ("8",)] and seen.sweep.exists()
    assert sent(seen, [{"id_email": 9, "ts": 40 * DAY}], 33 * DAY)["id_email"].tolist() == [9]


def given(value):
    return value is not None and value == value and value not in ("", 0)


def one_by_one(rows, mark, threads):
    """The rules of the thread memory, message after message."""
    out = []
    touched = {r["thread_id"] for r in rows}
    for t in touched:
        known, heard, newest = threads.get(t, ({}, {}, 0))
        if t not in threads or newest + STATE_TTL_MS <= mark:
            known, heard, newest = dict.fromkeys([*_FIELDS, "confianca"]), {}, 0
        for row in sorted((dict(r) for r in rows if r["thread_id"] == t), key=lambda r: (r["ts"], r["id_email"])):
            if row["id_email"] in heard:
                continue
            row["reject_reason"] = "late" if row["ts"] < mark else None
            if row["ts"] >= mark:
                heard[row["id_email"]], newest = row["ts"], max(newest, row["ts"])
                if row["listens"]:
                    said = {f: row[f] for f in _FIELDS if given(row[f])}
                    surest = max(row["confianca"] if given(row["confianca"]) else 0.0, known["confianca"] or 0.0)
                    if row["e_cotacao"]:
                        row.update({f: known[f] for f in _FIELDS if f not in said and given(known[f])})
                        row["confianca"] = surest
                    known.update(said)
                    known["confianca"] = surest
            out.append(row)
        threads[t] = known, {i: at for i, at in heard.items() if at >= mark}, max(newest, mark)
    return out


def test_threads_of_a_group_answer_as_one_by_one():
    draw, mark, plain = random.Random(5), 0, {}
    memory, handle = started(quotes.ThreadMemory())
    for round_ in range(6):
        rows = []
        for _ in range(60):
            at = (12 * round_ + draw.randrange(-9, 8)) * DAY + DAY * 20
            row = {"id_email": draw.randrange(300), "thread_id": draw.randrange(9), "ts": at, "remetente": draw.choice(["a", "b", None])}
            row |= {"e_cotacao": draw.random() < 0.7, "listens": draw.random() < 0.8, "confianca": draw.choice([None, 0.0, 0.4, 0.9])}
            row |= {f: draw.choice([None, "", "x", "y"]) for f in ("origem", "destino", "modal", "volumes")}
            rows.append(row | {"qtd_volumes": draw.choice([None, 0, 3]), "valor_nf": draw.choice([None, 0.0, 5.5]), "peso_kg": draw.choice([None, 2.0]), "m3_informado": None})
        # A thread that is silent for long is forgotten.
        rows = [r for r in rows if r["thread_id"] != 4 or round_ in (0, 5)]
        got, want = sent(memory, rows, mark), one_by_one(rows, mark, plain)
        names = ["thread_id", "id_email", "confianca", *_FIELDS, "reject_reason"]
        cell = lambda v: None if pd.isna(v) else v
        assert sorted([tuple(cell(v) for v in r) for r in got[names].astype(object).itertuples(index=False)], key=str) == sorted(
            [tuple(r[n] for n in names) for r in want], key=str
        )
        assert len(handle.timers) == 1
        mark = max(mark, max(r["ts"] for r in rows) - 7 * DAY)
