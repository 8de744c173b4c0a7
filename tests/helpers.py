"""Small inputs and plain-Python definitions to compare with."""

import datetime as dt
import math
import random

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KM = 1 / (math.pi / 180 * 6371)  # degrees of latitude in one kilometre

STAY = "user string, cid string, lon double, lat double, start_ts timestamp, end_ts timestamp, stay_s long"


def at(second):
    return BASE + dt.timedelta(seconds=second)


def stays(spark, rows, places, user="u", counts=False):
    """rows: (cell, start, end); places: cell -> kilometres north of a point."""
    data = [(user, c, 110.0, 20.0 + places[c] * KM, at(s), at(e), e - s) + ((1,) if counts else ()) for c, s, e in rows]
    return spark.createDataFrame(data, STAY + (", n_records long" if counts else ""))


def seconds(df, *cols):
    from pyspark.sql import functions as F

    base = int(BASE.timestamp())
    out = [(F.unix_timestamp(c) - base).alias(c) if c.endswith("_ts") or c == "ts" else F.col(c) for c in cols]
    return sorted(tuple(r) for r in df.select(*out).collect())


def random_stays(seed, users=4, n=60, cells=5, pause=(0, 1500), far=("3", "4")):
    rnd = random.Random(seed)
    rows = []
    for u in range(users):
        t = 0
        for _ in range(n if u else n * 3):
            c = str(rnd.randrange(cells))
            t += rnd.choice([0, 5, 20, rnd.randint(*pause)])
            e = t + rnd.choice([0, 0, 3, 40])
            lat = 20.0 + (60 + int(c) if c in far else int(c)) * KM
            rows.append((f"u{u}", c, 110.0, lat, at(t), at(e), e - t, rnd.randint(1, 3)))
            t = e
    return rows


def km4(a, b):
    if a == b:
        return 0.0
    (lon1, lat1), (lon2, lat2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    c = math.sin(lat1) * math.sin(lat2) + math.cos(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)
    return round(math.acos(max(-1.0, min(1.0, c))) * 6371, 4)


def by_user(rows):
    users = {}
    for r in rows:
        users.setdefault(r[0], []).append(r)
    return {u: sorted(v, key=lambda r: (r[4], r[5], r[1])) for u, v in users.items()}


def pieces(rows, gap):
    out = [[rows[0]]]
    for before, r in zip(rows, rows[1:]):
        if (r[4] - before[5]).total_seconds() < gap:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def naive_regions(seg):
    """Units of one segment: (first index, last index, is region)."""
    units, b = [], 0
    if len(seg) < 3:
        return [(i, i, False) for i in range(len(seg))]
    while b + 2 < len(seg):
        if seg[b][1] != seg[b + 2][1]:
            units.append((b, b, False))
            b += 1
            continue
        e = b + 2
        while True:
            known = {r[1] for r in seg[b:e + 1]}
            hit = next((t for t in (e + 1, e + 2) if t < len(seg) and seg[t][1] in known), None)
            if hit is None:
                break
            e = hit
        units.append((b, e, True))
        b = e + 1
    return units + [(i, i, False) for i in range(b, len(seg))]


def naive_drift(seg, adjacent, speed=60.0, far=4.0, cluster_s=10):
    n = len(seg)
    if n < 3:
        return list(seg)
    point = [(r[2], r[3]) for r in seg]
    kept, lost = [], set()

    def close(b, e):
        rows = [seg[i] for i in range(b, e + 1) if i not in lost]
        spent = (seg[e][5] - seg[b][4]).total_seconds()
        if not (spent < cluster_s and len({r[1] for r in rows}) < 3):
            kept.extend(rows)

    def pace(i, j):
        t = (seg[j][4] - seg[i][5]).total_seconds()
        d = km4(point[j], point[i])
        return d * 1000 / t if t and d else 0.0

    b = e = 0
    while e < n - 1:
        if (seg[e + 1][1], seg[e][1]) in adjacent or km4(point[e + 1], point[e]) <= far:
            e += 1
        elif e + 2 == n:
            if pace(e, e + 1) < speed:
                e += 1
            break
        else:
            d12, d02 = km4(point[e + 1], point[e + 2]), km4(point[e + 2], point[e])
            if d02 == 0:
                lost.add(e + 1)
                e += 2
            else:
                apart = d12 == 0 or d02 / d12 > 3
                close(b, e)
                if apart and d12 < far:
                    b, e = e + 1, e + 2
                else:
                    b = e = e + 2
    close(b, e)
    return kept
