from loomwright.operators.monitor import step_loss_average
from loomwright.sources.files import METRICS_SCHEMA, read_metrics, write_metrics
from loomwright.streaming import watch_step_losses


def test_live_averages_equal_the_batch(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for lot in range(2):
        rows = [("r", g, "train-loss", s, float(s + g + lot)) for g in range(2) for s in range(5)] + [("r", 0, "mix-in", 1, 9.0)]
        write_metrics(spark.createDataFrame(rows, METRICS_SCHEMA), path)
    stream = watch_step_losses(spark, path, 2)
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("live")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    live = {tuple(r) for r in spark.table("live").collect()}
    batch = {tuple(r) for r in step_loss_average(read_metrics(spark, path).where("tag = 'train-loss'"), 2).select(*stream.columns).collect()}
    assert live == batch and len(live) == 10
