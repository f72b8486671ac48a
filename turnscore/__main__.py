"""Command line: ``python -m turnscore <step> [paths...]`` runs one flow of
``turnscore.plans.flows`` on a session built from the environment (Spark
properties come from spark-submit / spark-defaults as usual)."""

from __future__ import annotations

import argparse

from turnscore.plans import flows


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="turnscore")
    sub = p.add_subparsers(dest="step", required=True)
    a = sub.add_parser("register", help="append new recordings to manifest and ledger")
    a.add_argument("video_root"), a.add_argument("ledger"), a.add_argument("manifest_out")
    a.add_argument("--checkpoint", help="run as an availableNow file stream with this checkpoint")
    a = sub.add_parser("clean", help="merge consecutive turns")
    a.add_argument("turns"), a.add_argument("out"), a.add_argument("--fmt", default="parquet")
    a.add_argument("--order", default="global", choices=["global", "subject"])
    a = sub.add_parser("distribution", help="real / synthetic score histogram")
    a.add_argument("scored"), a.add_argument("out")
    a = sub.add_parser("prepare", help="dialogue examples (JSON lines) and score histogram")
    a.add_argument("scored"), a.add_argument("examples_out"), a.add_argument("histogram_out")
    a = sub.add_parser("baseline", help="mean-predictor baselines")
    a.add_argument("examples"), a.add_argument("out_dir")
    a = sub.add_parser("cv", help="k-fold training and evaluation")
    a.add_argument("examples"), a.add_argument("out_dir")
    a.add_argument("--model", default="text_linear", choices=["text_linear", "text_absolute", "text_gbt", "topic_mean"])
    a.add_argument("--folds", type=int, default=5)
    a.add_argument("--features", type=int, help="number of hashed text features")
    a = sub.add_parser("curve", help="learning curve")
    a.add_argument("examples"), a.add_argument("out_dir")
    a.add_argument("--model", default="topic_mean", choices=["topic_mean", "text_linear"])
    a.add_argument("--features", type=int, help="number of hashed text features")
    a = sub.add_parser("compare", help="McNemar comparison of two confusion documents")
    a.add_argument("base_docs"), a.add_argument("tuned_docs"), a.add_argument("out_dir")
    a = sub.add_parser("similarity", help="real vs synthetic text similarity")
    a.add_argument("real"), a.add_argument("synthetic"), a.add_argument("out_dir")
    a.add_argument("--encoder", help="Python file that defines load() and encode(model, texts)")
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession
    spark = SparkSession.builder.appName(f"turnscore-{args.step}").getOrCreate()
    if args.step == "register" and args.checkpoint:
        flows.register_recordings_stream(spark, args.video_root, args.ledger, args.manifest_out, args.checkpoint)
    elif args.step == "register":
        flows.register_recordings(spark, args.video_root, args.ledger, args.manifest_out)
    elif args.step == "clean":
        flows.clean_transcripts(spark, args.turns, args.out, args.fmt, args.order)
    elif args.step == "distribution":
        flows.score_distribution(spark, args.scored, args.out)
    elif args.step == "prepare":
        flows.prepare_examples(spark, args.scored, args.examples_out, args.histogram_out)
    elif args.step == "baseline":
        flows.mean_baseline(spark, args.examples, args.out_dir)
    elif args.step == "cv":
        flows.cross_validate(spark, args.examples, args.out_dir, k=args.folds, model=args.model, features=args.features)
    elif args.step == "curve":
        flows.learning_curve(spark, args.examples, args.out_dir, model=args.model, features=args.features)
    elif args.step == "compare":
        flows.compare_models(spark, args.base_docs, args.tuned_docs, args.out_dir)
    elif args.step == "similarity":
        flows.similarity_report(spark, args.real, args.synthetic, args.out_dir, encoder=args.encoder)


if __name__ == "__main__":
    main()
