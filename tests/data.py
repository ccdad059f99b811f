"""Made-up visits: a harbour town's places, sessions of one to six visits, some at night and at the weekend."""

VENUES = {"pier": "Dock", "mill": "Work", "forge": "Work", "green": "Field", "tower": "View", "arch": "View", "cave": "Deep"}

# split, user, first hour (day of June 2025 and hour), hours between visits, places
SESSIONS = [
    ("train", "otto", (2, 6), 2, "pier mill mill forge green pier"),
    ("train", "pia", (4, 21), 1, "tower arch tower"),
    ("train", "quin", (7, 13), 3, "green green pier tower"),
    ("train", "rosa", (8, 7), 1, "mill forge mill forge cave"),
    ("train", "otto", (9, 16), 1, "arch"),
    ("validation", "pia", (16, 8), 2, "mill forge arch mill"),
    ("validation", "sven", (21, 22), 1, "tower pier"),
    ("test", "rosa", (23, 5), 4, "pier green tower forge mill"),
    ("test", "tess", (25, 12), 1, "cave"),
    ("test", "otto", (28, 18), 1, "arch tower pier"),
]


def visits():
    rows = []
    for n, (split, user, (day, hour), step, places) in enumerate(SESSIONS):
        for k, place in enumerate(places.split()):
            at = day * 24 + hour + k * step
            rows.append((split, user, f"walk-{n}", f"2025-06-{at // 24:02d}T{at % 24:02d}:00:00Z", place, VENUES[place]))
    return rows


def write_csv(folder, split, rows=None, header="raw_user_id,session_id,timestamp,raw_poi_id,category"):
    path = folder / f"{split}.csv"
    rows = [r[1:] for r in visits() if r[0] == split] if rows is None else rows
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


EVENT = {
    "request_id": "event-1", "versions": {"release": "r", "data": "d", "model": "m"}, "history_length_bucket": "2-5", "unknown_count": 0, "candidate_count": 7,
    "candidate_source_histogram": {"global_popularity": 7}, "category_histogram": {"category_0123456789abcdef": 5}, "score_entropy": 1.0, "stage_latency_ms": {"rank": 1.5},
    "total_latency_ms": 2.0, "status": "ok", "error_code": None,
}
