"""Command line: import receipts, status, run or follow an indexer, serve remote clients, answer one API call."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.functions.keccak import address
from chainfold.plans import erc20
from chainfold.plans.manifest import Manifest
from chainfold.plans.runner import Handler, Indexer, Reader
from chainfold.sources import receipts, rpc
from chainfold.sources.schemas import FINALITY
from chainfold.sources.store import BlockStore, PendingStore
from chainfold.streaming.ingest import SPAN, HeadIngest
from chainfold.streaming.remote import Server


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chainfold")
    top.add_argument("--verbose", action="store_true", help="say what is scanned, filled and committed, besides reorganisations")
    top.add_argument("--quiet", action="store_true", help="say errors only")
    sub = top.add_subparsers(dest="command", required=True)
    load = sub.add_parser("import", help="take receipts, bodies and headers from a Parquet dump into a store")
    load.add_argument("dump", help="Parquet with block_number, receipts, header and perhaps body")
    load.add_argument("store")
    load.add_argument("--head", type=int, help="the chain's head; blocks less than the finality depth below it are left out")
    status = sub.add_parser("status", help="rows and spans of a store's tables")
    status.add_argument("store")
    load.add_argument("--hashes", help="Parquet with block_number and block_hash of the canonical chain, for blocks that are there twice")
    load.add_argument("--span", type=int, default=SPAN, help="blocks between two published checkpoints")
    run = sub.add_parser("run", help="index a token, or a module's manifest")
    head = sub.add_parser("follow", help="ingest a node's head and keep a token's or a module's tables up to it")
    head.add_argument("url", help="a JSON-RPC node, or file: and a recording")
    head.add_argument("--until", type=int, help="stop when the head is there")
    head.add_argument("--every", type=float, default=1.0, help="seconds between two looks at the head")
    for p in (run, head):
        p.add_argument("store")
        p.add_argument("out")
        p.add_argument("token", nargs="?", help="checksummed address")
        p.add_argument("--module", help="a module with `manifest` and `handler`")
        p.add_argument("--args", default="{}", help="JSON keywords of the module's manifest; 0x texts are checksummed addresses")
        p.add_argument("--start", type=int, default=0)
        p.add_argument("--end", type=int)
    serve = sub.add_parser("serve", help="answer the requests of remote clients in a shared folder")
    serve.add_argument("store")
    serve.add_argument("pending")
    serve.add_argument("folder")
    serve.add_argument("--rounds", type=int, default=1, help="how often to look at the folder")
    serve.add_argument("--every", type=float, default=1.0, help="seconds between two rounds")
    ask = sub.add_parser("ask", help="health, account ADDRESS, allowance OWNER SPENDER, or transfers")
    for name in ("store", "out", "token", "what"):
        ask.add_argument(name)
    ask.add_argument("args", nargs="*")
    ask.add_argument("--limit", type=int, default=20)
    ask.add_argument("--offset", type=int, default=0)
    ask.add_argument("--start", type=int, default=0)
    ask.add_argument("--end", type=int)
    return top


def load_dump(spark: SparkSession, dump_path: str, store: BlockStore, head: int | None = None, hashes: DataFrame | None = None, span: int = SPAN) -> int | None:
    """Take a dump into the store in spans of blocks, each published before the next, from where the store ends.

    Blocks that a reorganisation left in the dump twice are resolved by canonical hashes.
    """
    dump = spark.read.parquet(dump_path)
    if head is not None:
        dump = dump.where(F.col("block_number") <= head - FINALITY)
    last = store.meta["last_final"]
    if last is not None:
        dump = dump.where(F.col("block_number") > last)
    low, high = dump.agg(F.min("block_number"), F.max("block_number")).first()
    for start in range(low, high + 1, span) if low is not None else ():
        part = receipts.resolved(dump.where(F.col("block_number").between(start, start + span - 1)), hashes)
        txs = receipts.block_txs(part) if "body" in dump.columns else None
        last = store.append(receipts.receipt_logs(part), receipts.header_blocks(part), txs)
    return last


def project(args: argparse.Namespace) -> tuple[Manifest, Handler]:
    """The manifest and handler to run: a token's, or those of a module, whose `manifest` takes the keywords of --args."""
    if not args.module:
        return erc20.manifest(address(args.token), args.start, args.end), erc20.handler
    module = importlib.import_module(args.module)
    return module.manifest(**{k: address(v) if isinstance(v, str) and v.startswith("0x") else v for k, v in json.loads(args.args).items()}), module.handler


def follow(spark: SparkSession, indexer: Indexer, store: BlockStore, args: argparse.Namespace) -> int:
    """Ingest the node's head and fold it, until the head passes --until."""
    ingest = HeadIngest(spark, store, PendingStore(spark, f"{args.out}/pending"), rpc.chain(spark, args.url, indexer.manifest.wants_tx))
    follower = None
    while True:
        head = int(rpc.call_node(args.url, "eth_blockNumber", []), 16)
        ingest.advance(head, start=indexer.manifest.start_block)
        follower = follower or indexer.start()
        blocks, logs, last_final = ingest.snapshot()
        indexer.pending_txs = ingest.pending.read()[2]
        follower.tick(blocks, logs, follower.cursor if last_final is None else last_final)
        if args.until is not None and head >= args.until:
            return head
        time.sleep(args.every)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
    logging.getLogger("chainfold").setLevel(logging.INFO if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
    spark = spark or SparkSession.builder.appName("chainfold").getOrCreate()
    store = BlockStore(spark, args.store)
    if args.command == "import":
        hashes = spark.read.parquet(args.hashes) if args.hashes else None
        out = f"last final block: {load_dump(spark, args.dump, store, args.head, hashes, args.span)}"
    elif args.command == "serve":
        server, frames = Server(spark, store, PendingStore(spark, args.pending), args.folder), 0
        for k in range(args.rounds):
            time.sleep(args.every if k else 0)
            frames += server.poll()
        out = f"frames: {frames}"
    elif args.command == "status":
        out = "\n".join(json.dumps(r.asDict()) for r in store.status().collect())
    elif args.command == "follow":
        indexer = Indexer(spark, store, args.out, *project(args))
        out = json.dumps({"head": follow(spark, indexer, store, args), "cursor": indexer.follower.cursor})
    else:
        args.module = getattr(args, "module", None)
        indexer = Indexer(spark, store, args.out, *project(args))
        if args.command == "run":
            version = indexer.run()
            out = json.dumps({"version": version.number, "cursor": version.cursor, "scanned_to": version.scanned_to, "counts": version.counts})
        else:
            api = erc20.Api(Reader(indexer))
            found = api.transfers(args.limit, args.offset) if args.what == "transfers" else getattr(api, args.what)(*args.args)
            out = json.dumps(found)
    print(out)
    return out


if __name__ == "__main__":
    main()
