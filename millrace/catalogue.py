"""The queries of the retrieval engine, by name, and their SQL."""

from __future__ import annotations

from millrace.plans import chats, context, flows, ingest, retrieve
from millrace.session import ship


def _shipped(f):
    def run(spark, sf_dir):
        return f(ship(spark), sf_dir)

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


QUERIES = {name: _shipped(f) for module in (ingest, retrieve, chats, flows, context) for name, f in module.Q.items()}
ORACLES = {name: sql for module in (ingest, retrieve, chats, flows, context) for name, sql in module.SQLS.items()}
