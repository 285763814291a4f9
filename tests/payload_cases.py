"""Payloads for tests, as JSON text; ``result(...)`` fills in what a test cares about."""

from __future__ import annotations

import json

#: One saved post as the timeline reports it.
RESULT = """
{"__typename": "Tweet", "rest_id": "?",
 "legacy": {"full_text": "?", "lang": "pt", "favorite_count": 11, "retweet_count": 2,
            "created_at": "Sat Mar 14 09:26:53 +0000 2020",
            "entities": {"hashtags": [{"text": "cais"}, {"text": ""}], "user_mentions": [{"screen_name": "porto"}],
                         "urls": [{"url": "https://t.co/aa", "expanded_url": "https://rio.example/um"},
                                  {"url": "https://t.co/bb"}]}},
 "views": {"count": "1618"},
 "core": {"user_results": {"result": {"legacy": {"screen_name": "?", "name": "Dona ?"}}}}}
"""


def result(id_, text="olá", handle="maria", **legacy) -> dict:
    found = json.loads(RESULT)
    found["rest_id"] = str(id_)
    found["legacy"] |= {"full_text": text} | legacy
    user = found["core"]["user_results"]["result"]["legacy"]
    user |= {"screen_name": handle, "name": user["name"].replace("?", handle)}
    return found


def timeline(*results) -> dict:
    """A payload with the results in order, among other things a payload holds."""
    places = [{"entryId": f"post-{k}", "content": {"itemContent": {"tweet_results": {"result": r}}}}
              for k, r in enumerate(results)]
    cursor = {"entryId": "cursor-bottom", "content": {"cursorType": "Bottom", "value": "zzz"}}
    return {"data": {"saved": {"timeline": {"instructions": [{"type": "Clear"}, {"type": "Add", "entries": [*places, cursor]}]}}}}
