"""Command line: validate, explain, run, ai (status, evaluate, review, dispatch-plan), transform test, inspect connector."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from millrace.operators import arrow_step, dispatch, evaluate, review
from millrace.operators.ledger import Ledger
from millrace.operators.providers import provider_for
from millrace.plans import compiler, registry
from millrace.plans import spec as S


def _doc(path: str) -> dict:
    with open(path) as f:
        return S.parse(f.read())


def _session():
    from millrace.session import local_session

    return local_session()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="verb", required=True)
    for name in ("validate", "explain", "run"):
        c = sub.add_parser(name)
        c.add_argument("pipeline")
        if name == "explain":
            c.add_argument("--json", action="store_true")
        if name == "run":
            c.add_argument("--smoke", action="store_true")
            c.add_argument("--smoke-rows", type=int, default=compiler.SMOKE_ROWS)
    ai = sub.add_parser("ai").add_subparsers(dest="ai", required=True)
    ai.add_parser("status")
    e = ai.add_parser("evaluate")
    e.add_argument("corpus")
    e.add_argument("--provider", default="mock")
    e.add_argument("--model", default="mock-1")
    e.add_argument("--limit", type=int)
    e.add_argument("--out")
    r = ai.add_parser("review").add_subparsers(dest="review", required=True)
    r.add_parser("list")
    r.add_parser("export")
    a = r.add_parser("accept")
    a.add_argument("key")
    a.add_argument("output")
    r.add_parser("reject").add_argument("key")
    d = ai.add_parser("dispatch-plan")
    d.add_argument("--sweep", action="store_true")
    d.add_argument("--json", action="store_true")
    t = sub.add_parser("transform").add_subparsers(dest="transform", required=True).add_parser("test")
    t.add_argument("component", help="module:function")
    i = sub.add_parser("inspect").add_subparsers(dest="inspect", required=True).add_parser("connector")
    i.add_argument("id", nargs="?")
    i.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit code 2 for an invalid document, 1 for any other error."""
    a = _parser().parse_args(argv)
    try:
        return _run(a)
    except S.SpecError as e:
        print("\n".join(e.issues), file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    if a.verb == "validate":
        _doc(a.pipeline)
        print("valid")
    elif a.verb == "explain":
        lines = compiler.explain(_doc(a.pipeline))
        print(json.dumps(lines) if a.json else "\n".join(lines))
    elif a.verb == "run":
        s = compiler.run(_session(), _doc(a.pipeline), a.smoke, a.smoke_rows)
        print("nothing to do" if s.nothing_to_do else json.dumps({"units": s.units, "rowsIn": s.rows_in, "rowsOut": s.rows_out, "steps": {k: {"calls": v.calls, "reused": v.reused, "tokens": v.tokens, "dropped": v.dropped, "withheld": v.withheld} for k, v in s.steps.items()}}))
    elif a.verb == "transform":
        module, _, name = a.component.partition(":")
        wrong = arrow_step.conformance(getattr(importlib.import_module(module), name))
        print("\n".join(wrong) or "conforms")
        return int(bool(wrong))
    elif a.verb == "inspect":
        found = [registry.find(a.id)] if a.id else registry.CONNECTORS
        print(json.dumps(found, indent=2) if a.json else "\n".join(f"{c['id']:24} {c['role']:10} {c['level']:10} {', '.join(c['modes'])}" for c in found))
    elif a.ai == "dispatch-plan":
        table = dispatch.frontier(_session())
        print("\n".join(table.toJSON().collect()) if a.json else dispatch.to_markdown(table))
    elif a.ai == "evaluate":
        with open(a.corpus) as f:
            corpus = evaluate.load_corpus(f.read())
        items, result = evaluate.run(_session(), corpus, provider_for({"provider": a.provider, "model": a.model}), a.limit)
        print(json.dumps(result, indent=2))
        if a.out:
            print(evaluate.persist(items, result, a.out, a.model))
    else:
        ledger = Ledger(compiler.ledger_path())
        if a.ai == "status":
            print(json.dumps({"work": ledger.counts(), "reviews": ledger.review_counts()}))
        elif a.review == "list":
            for r in ledger.reviews():
                print(r["work_key"][:12], r["transform_id"], r["reason"])
        elif a.review == "export":
            sys.stdout.write(review.export(ledger))
        elif a.review == "accept":
            print(review.accept(ledger, ledger.find(a.key), a.output))
        else:
            review.reject(ledger, ledger.find(a.key))
    return 0


if __name__ == "__main__":
    sys.exit(main())
