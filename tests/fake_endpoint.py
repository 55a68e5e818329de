"""A transport for the data source test: 400 records, served whole."""

from datetime import date, timedelta

ROWS = [{"complaint_id": str(i), "date_received": (date(2024, 1, 1) + timedelta(days=i % 40)).isoformat(), "product": "ab"[i % 2]} for i in range(400)]


def make():
    def get(params):
        hit = [r for r in ROWS if r["product"] in params["product"] and params["date_received_min"] <= r["date_received"] <= params["date_received_max"]]
        return 200, {"hits": {"total": {"value": len(hit), "relation": "eq"}, "hits": [{"_source": r} for r in hit[: params["size"]]]}}

    return get
