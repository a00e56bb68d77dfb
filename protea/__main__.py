"""Command line over the workflows (run with spark-submit or python -m).

    python -m protea vote   --queries test.fasta --ref NAME:TERMS:FASTA ... --out submission.tsv
    python -m protea embed  --input sequence.parquet --output emb.parquet --style spaced
    python -m protea train  --model boost --sequences seq.parquet --embeddings emb.parquet \\
                            --labels label.parquet --test test.csv --test-embeddings temb.parquet \\
                            --output pred.parquet [--top-k 3000]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _ref(spec: str):
    from protea.plans.workflows import ReferenceSet
    name, terms, src = spec.split(":", 2)
    if src.startswith("hits="):
        return ReferenceSet(name, terms, hits=src[5:])
    meta = src.startswith("meta=")
    return ReferenceSet(name, terms, fasta=src[5:] if meta else src, has_metadata=meta)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="protea")
    sub = ap.add_subparsers(dest="cmd", required=True)
    v = sub.add_parser("vote", help="similarity search / hits -> weighted vote -> merged TSV")
    v.add_argument("--queries", required=True)
    v.add_argument("--ref", action="append", required=True,
                   help="NAME:TERMS:FASTA, NAME:TERMS:meta=FASTA (db|id|name headers) or NAME:TERMS:hits=TSV")
    v.add_argument("--out", required=True)
    v.add_argument("--evalue", type=float, default=1e-3)
    v.add_argument("--max-targets", type=int, default=16)
    e = sub.add_parser("embed", help="sequence Parquet -> embedding Parquet")
    e.add_argument("--input", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--style", choices=["truncated", "spaced", "chunked"], default="truncated")
    e.add_argument("--k", type=int, default=1)
    t = sub.add_parser("train", help="train and score")
    t.add_argument("--model", choices=["boost", "mlp"], default="boost")
    for a in ("sequences", "embeddings", "labels", "test", "test-embeddings", "output"):
        t.add_argument(f"--{a}", required=True)
    t.add_argument("--taxonomy")
    t.add_argument("--test-taxonomy")
    t.add_argument("--top-k", type=int)
    t.add_argument("--threshold", type=float, default=0.01)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"protea-{args.cmd}").getOrCreate()
    from protea.plans import workflows
    if args.cmd == "vote":
        workflows.homology_vote(spark, args.queries, [_ref(r) for r in args.ref], args.out,
                                evalue=args.evalue, max_targets=args.max_targets)
    elif args.cmd == "embed":
        workflows.embed_sequences(spark, args.input, args.output, style=args.style, k=args.k)
    else:
        workflows.train_and_score(spark, args.sequences, args.embeddings, args.labels, args.test,
                                  args.test_embeddings, args.output, args.model, top_k=args.top_k,
                                  taxonomy_path=args.taxonomy, test_taxonomy_path=args.test_taxonomy,
                                  threshold=args.threshold)


if __name__ == "__main__":
    main()
