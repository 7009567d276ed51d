"""Queries ask for the texts that they look at."""

import inspect

from lakewarden.plans import code


def test_dynamic_events_ask_for_texts_of_one_call():
    assert all("C.DYNAMIC_TEXTS" in inspect.getsource(f) for f in (code.dynamic_events, code.dynamic_summary))


def test_routes_ask_for_texts_of_decorated_functions():
    assert '"decorated"' in inspect.getsource(code._routes)
