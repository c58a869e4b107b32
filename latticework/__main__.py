"""python -m latticework init|validate|inspect|process|analyze|suggest|transform ...: exit code 2 for bad input, 1 for failures."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import time
from pathlib import Path

from . import __version__
from .kernels.geometry import RIGS
from .plans.config import Config, ConfigError


def _config(path: str | None) -> Config:
    return Config.parse(Path(path).read_text()) if path else Config.default()


def _radius(text: str) -> int:
    if not text.isdecimal() or int(text) > 256:
        raise argparse.ArgumentTypeError("must be an integer from 0 to 256")
    return int(text)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="latticework")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("file")
    init.add_argument("--force", action="store_true")
    for name in ("validate",):
        sub.add_parser(name).add_argument("preset")
    for name in ("inspect", "process", "analyze", "suggest", "transform"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--preset")
        c.add_argument("--recursive", action=argparse.BooleanOptionalAction, help="overrides the preset")
        c.add_argument("--include", nargs="+", metavar="GLOB", help="overrides the preset")
        c.add_argument("--exclude", nargs="+", metavar="GLOB", help="overrides the preset")
        if name != "inspect":
            c.add_argument("--out", required=True)
        if name == "transform":
            c.add_argument("--template", choices=sorted(RIGS), default="human")
            c.add_argument("--dilation", type=_radius, default=8)
        if name == "suggest":
            c.add_argument("--config", help="JSON file with the provider's settings")
            c.add_argument("--cache", action=argparse.BooleanOptionalAction, default=True)
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if args.command == "init":
            target = Path(args.file)
            if target.exists() and not args.force:
                print(f"{target} exists; use --force", file=sys.stderr)
                return 2
            target.write_text(Config.default().to_json())
            return 0
        cfg = _config(args.preset)
    except ConfigError as e:
        for problem in e.problems:
            print(f"{problem.path}: {problem.message} [{problem.code}]", file=sys.stderr)
        return 2
    except OSError as e:
        print(f"INPUT_NOT_FOUND: {e}", file=sys.stderr)
        return 2
    if args.command == "validate":
        print("valid")
        return 0
    return _run(args, cfg)


def _run(args, cfg: Config) -> int:
    from .operators import enrich, images, rules
    from .plans import exports
    from .session import get_session
    from .sources import images as source

    root = str(Path(args.folder).resolve())
    if not Path(root).is_dir():
        print(f"INPUT_NOT_FOUND: {root}", file=sys.stderr)
        return 2
    spark = get_session()
    chosen = {k: getattr(args, k) for k in ("recursive", "include", "exclude") if getattr(args, k) is not None}
    wanted = cfg.input | chosen
    decoded = source.decode(source.scan(spark, root, wanted["recursive"], wanted["include"], wanted["exclude"]))
    out = Path(getattr(args, "out", ".") or ".")
    out.mkdir(parents=True, exist_ok=True)
    failed = 0
    if args.command == "inspect":
        done = images.process(decoded, cfg, with_pixels=False)
        for r in done.orderBy("source").toLocalIterator():
            print(f"{r.source} {r.status} {r.message}" if r.status != "ok" else exports.listing(r.asDict(True), cfg.detect))
            failed += r.status != "ok"
    elif args.command == "process":
        began = time.monotonic()
        done = images.process(decoded, cfg).persist()
        exports.write_files(done, str(out.resolve()), "latticework", __version__, cfg.output)
        totals = exports.summary(done)
        stems = ((r.source.rsplit(".", 1)[0], r.n) for r in done.where("status = 'ok'").selectExpr("source", "size(pages) AS n").orderBy("source").toLocalIterator())
        outputs = [str(out / stem / f) for stem, n in stems for f in exports.output_names(stem.rsplit("/", 1)[-1], n, cfg.output)]
        took = {"durationMs": int((time.monotonic() - began) * 1000), "outputs": [*outputs, str(out / "summary.json")]}
        errors = totals.pop("errors")
        (out / "summary.json").write_text(exports.pretty(totals | took | {"errors": errors}))
        failed = totals["failed"]
    elif args.command == "analyze":
        assets = images.features(decoded).persist()
        q = cfg.quality
        issues = rules.analyze(assets, q["characterPatterns"], q["nonDescriptivePatterns"], q["maxTransparentRatio"], q["duplicateHammingThreshold"])
        failed = exports.write_quality(rules.report(assets, issues), decoded.where("status <> 'ok'").select("source", "stage", "message"), out)
    elif args.command == "suggest":
        from .plans import provider

        try:
            settings = provider.Settings.resolve(json.loads(Path(args.config).read_text()) if args.config else None)
        except (OSError, ValueError) as e:
            print(f"AI_CONFIG_INVALID: {e}", file=sys.stderr)
            return 2
        place = (out / "answers").resolve() if args.cache else Path(tempfile.mkdtemp(prefix="latticework-"))
        results = provider.understand(images.features(decoded), provider.AnswerCache(spark, str(place)), settings).persist()
        for name, parts in provider.sidecars(results, settings).items():
            with (out / name).open("w", encoding="utf-8") as f:
                f.writelines(parts)
    else:
        from .plans import project

        for r in project.transform(decoded, cfg, args.template, dilation=args.dilation).toLocalIterator():
            failed += r.status != "ok"
            if r.status == "ok":
                base, doc = out / r.source.rsplit(".", 1)[0], json.loads(r.project)
                scene = base / "godot-export"
                for folder in (base, scene):
                    (folder / "layers").mkdir(parents=True, exist_ok=True)
                    for f in r.files:
                        (folder / f.name).write_bytes(f.png)
                (base / "project.json").write_text(exports.pretty(doc))
                for name, text in project.scene_files(doc).items():
                    (scene / name).write_text(text)
                failed += not doc["layers"]
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
