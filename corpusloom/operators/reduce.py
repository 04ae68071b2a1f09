"""Dimension reduction: applying an encoder, its error, and fitting one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vectors import as_double
from corpusloom.operators.batches import BROADCAST_BYTES, map_batches, to_lists, to_matrix
from corpusloom.operators.split import hash_key
from corpusloom.storage import exists, new_path, remove

# Hidden widths of the two encoder sizes.
HIDDEN = (512,)
HIDDEN_BIGGER = (768, 512)

LAYER_SCHEMA = "layer int, row int, weights array<double>, bias double"


@dataclass(frozen=True)
class Layer:
    """``x @ weight.T + bias``, then ReLU if asked for."""

    weight: np.ndarray
    bias: np.ndarray
    relu: bool = True


def _share(spark: SparkSession, layers: Sequence[Layer]):
    """Broadcast the layers as plain arrays, which executors can read without this package."""
    return spark.sparkContext.broadcast([(la.weight, la.bias, la.relu) for la in layers])


def _layers(shared) -> list[Layer]:
    return [Layer(*parts) for parts in shared.value]


@dataclass(frozen=True)
class Autoencoder:
    encoder: tuple[Layer, ...]
    decoder: tuple[Layer, ...]


def apply_layers(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    for layer in layers:
        x = x @ layer.weight.T + layer.bias
        if layer.relu:
            x = np.maximum(x, 0.0)
    return x


def _check_size(layers: Sequence[Layer]) -> None:
    size = sum(8 * (la.weight.size + la.bias.size) for la in layers)
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of weights are over the bound of {BROADCAST_BYTES}")


def split_by_width(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector is ``dim`` wide, and the rejected rest."""
    fits = F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(
        vector, lambda x: x.isNull())
    return df.where(fits), df.where(~F.coalesce(fits, F.lit(False)))


def _fitting(column: pa.Array, width: int) -> pa.Array:
    """Which lists have ``width`` numbers, none of them null."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = column.flatten()
    if values.null_count:
        owner = pc.list_parent_indices(column).filter(values.is_null()).to_numpy()
        whole = np.ones(len(column), bool)
        whole[owner] = False
        fits = pc.and_(fits, pa.array(whole))
    return fits


def _spread(values: pa.Array, fits: pa.Array) -> pa.Array:
    """``values`` at the places that fit, null at the others."""
    place = np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1
    return values.take(pa.array(place, mask=~fits.to_numpy(zero_copy_only=False)))


def encode_mlp(df: DataFrame, layers: Sequence[Layer], keep: Sequence[str],
               vector: str = "embedding", name: str = "reduced") -> DataFrame:
    """Append the output of the layers; null for a vector of a wrong width."""
    _check_size(layers)
    shared = _share(df.sparkSession, layers)
    width = layers[0].weight.shape[1]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        fits = _fitting(batch.column(vector), width)
        made = apply_layers(to_matrix(batch.column(vector).filter(fits), width), _layers(shared))
        return {name: _spread(to_lists(made.astype(np.float32), pa.float32()), fits)}

    new = T.StructType([T.StructField(name, T.ArrayType(T.FloatType()))])
    return map_batches(df, keep, vector, new, compute)


def reconstruction_error(df: DataFrame, model: Autoencoder, keep: Sequence[str],
                         vector: str = "embedding") -> DataFrame:
    """Append ``error``, the mean squared difference of a vector to its reconstruction.

    Null for a vector of a wrong width.
    """
    layers = (*model.encoder, *model.decoder)
    _check_size(layers)
    shared = _share(df.sparkSession, layers)
    width = layers[0].weight.shape[1]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        fits = _fitting(batch.column(vector), width)
        x = to_matrix(batch.column(vector).filter(fits), width)
        error = ((apply_layers(x, _layers(shared)) - x) ** 2).mean(axis=1)
        return {"error": _spread(pa.array(error, pa.float64()), fits)}

    return map_batches(df, keep, vector, T.StructType([
        T.StructField("error", T.DoubleType())]), compute)


def reconstruction_mse(df: DataFrame, model: Autoencoder, keep: Sequence[str],
                       vector: str = "embedding") -> DataFrame:
    """``mse`` over the usable rows, and how many rows there are and were rejected."""
    return reconstruction_error(df, model, keep, vector).agg(
        F.avg("error").alias("mse"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("error").isNull()).alias("n_rejected"))


def fit_pca(df: DataFrame, dim: int, vector: str = "embedding") -> Autoencoder:
    """The best linear reduction to ``dim`` numbers, as an encoder and decoder.

    Only the covariance, whose size is set by the width, reaches the driver.
    """
    points = df.select(array_to_vector(as_double(F.col(vector))).alias("features"))
    axes = PCA(k=dim, inputCol="features", outputCol="out").fit(points).pc.toArray()
    mean = np.array(points.agg(vector_to_array(Summarizer.mean(F.col("features")))).first()[0])
    encoder = Layer(axes.T, -axes.T @ mean, relu=False)
    decoder = Layer(axes, mean, relu=False)
    return Autoencoder((encoder,), (decoder,))


def _start(widths: Sequence[int], rng: np.random.Generator, last_relu: bool) -> list[Layer]:
    layers = []
    for i, (a, b) in enumerate(zip(widths[:-1], widths[1:])):
        bound = 1 / np.sqrt(a)
        relu = last_relu or i < len(widths) - 2
        layers.append(Layer(rng.uniform(-bound, bound, (b, a)), rng.uniform(-bound, bound, b), relu))
    return layers


def _gradients(x: np.ndarray, layers: Sequence[Layer]) -> tuple[float, list[np.ndarray]]:
    """Squared error and its gradients, summed over the rows."""
    outs = [x]
    for layer in layers:
        outs.append(apply_layers(outs[-1], [layer]))
    gap = outs[-1] - x
    back = 2.0 * gap / x.shape[1]
    grads: list[np.ndarray] = []
    for layer, before, after in zip(layers[::-1], outs[-2::-1], outs[:0:-1]):
        if layer.relu:
            back = back * (after > 0)
        grads += [back.sum(axis=0), back.T @ before]
        back = back @ layer.weight
    return float((gap ** 2).mean(axis=1).sum()), grads[::-1]


#: Copies of the weights that are trained at the same time, and the numbers in a row of weights.
LANES = 8
PIECE = 16_384

_EPOCH = "piece int, total array<double>, rows long, steps long, loss double"
_ERRORS = "error double, loss double, steps long, widths array<int>"


def _flat(layers: Sequence[Layer]) -> np.ndarray:
    return np.concatenate([p.ravel() for la in layers for p in (la.weight, la.bias)])


def _filled(flat: np.ndarray, layers: Sequence[Layer]) -> list[Layer]:
    """Layers of the same shapes over the numbers of ``flat``, which they share."""
    made, at = [], 0
    for la in layers:
        end = at + la.weight.size
        made.append(Layer(flat[at:end].reshape(la.weight.shape), flat[end:end + la.bias.size], la.relu))
        at = end + la.bias.size
    return made


class _Lane:
    """Weights and Adam's moments in one array, moved in place."""

    def __init__(self, state: np.ndarray, steps: int, layers: Sequence[Layer], rate: float):
        self.state, self.steps, self.rate = state.copy(), steps, rate
        self.weights, self.first, self.second = self.state.reshape(3, -1)
        self.layers = _filled(self.weights, layers)
        self.rows, self.loss = 0, 0.0
        self._sum, self._count = None, 0

    def add(self, x: np.ndarray) -> None:
        """Gradients of some rows of the current step."""
        loss, grads = _gradients(x, self.layers)
        flat = np.concatenate([g.ravel() for g in grads])
        self._sum = flat if self._sum is None else self._sum + flat
        self._count += len(x)
        self.loss += loss

    def move(self) -> None:
        """One step of Adam with the mean gradient of what was added."""
        if not self._count:
            return
        g = self._sum / self._count
        self.rows, self.steps = self.rows + self._count, self.steps + 1
        self.first[:] = 0.9 * self.first + 0.1 * g
        self.second[:] = 0.999 * self.second + 0.001 * g * g
        self.weights -= self.rate * (self.first / (1 - 0.9 ** self.steps)) / (
            np.sqrt(self.second / (1 - 0.999 ** self.steps)) + 1e-8)
        self._sum, self._count = None, 0


def _dealt(train: DataFrame, n_train: int, key: str, vector: str, lanes: int, steps: int,
           batch_size: int, seed: int) -> DataFrame:
    """Rows of one epoch, drawn in one pass, each lane's in one partition by step.

    A row takes part as often as its share of the epoch says; the rest of the share is a chance.
    """
    share = lanes * steps * batch_size / n_train
    digest = F.conv(F.left("_d", F.lit(8)), 16, 10).cast("bigint")
    uses = F.lit(int(share)) + (digest < int((share - int(share)) * (1 << 32))).cast("int")
    place = F.pmod(F.xxhash64("_d", "_use", "_v"), F.lit(lanes * steps))
    return (
        train.select(vector, hash_key(key, seed).alias("_d"), F.xxhash64(vector).alias("_v"))
        .withColumn("_uses", uses).where("_uses > 0")
        .withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
        .withColumn("_place", place)
        .select(vector, F.floor(F.col("_place") / steps).cast("int").alias("lane"),
                (F.col("_place") % steps).cast("int").alias("step"), "_d", "_use", "_v")
        .repartitionById(lanes, F.col("lane"))
        .sortWithinPartitions("lane", "step", "_d", "_use", "_v")
        .select("lane", "step", vector))


def _trained(dealt: DataFrame, state: np.ndarray, steps: int, layers: Sequence[Layer], rate: float,
             vector: str) -> DataFrame:
    """Pieces of the weights and moments after an epoch, the mean of all lanes.

    A lane starts from the same weights and takes its own steps on its own rows; lanes count
    by their rows. A task holds one lane's weights and one Arrow batch, whatever a step's size.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(
        (state, [(la.weight.shape, la.relu) for la in layers]))

    def sent(lane: int, done: _Lane) -> Iterator[pa.RecordBatch]:
        done.move()
        for piece, at in enumerate(range(0, len(done.state), PIECE)):
            yield pa.RecordBatch.from_arrays([
                pa.array([lane], pa.int32()), pa.array([piece], pa.int32()),
                to_lists(done.state[at:at + PIECE][None, :], pa.float64()),
                pa.array([done.rows], pa.int64()), pa.array([done.steps], pa.int64()),
                pa.array([done.loss], pa.float64())],
                names=["lane", "piece", "total", "rows", "steps", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, shapes = shared.value
        blank = [Layer(np.empty(shape), np.empty(shape[0]), relu) for shape, relu in shapes]
        width, held, lane = shapes[0][0][1], None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            x = to_matrix(b.column(vector), width)
            at = np.stack([b.column("lane").to_numpy(), b.column("step").to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = (int(at[i, 0]), int(at[i, 1]))
                if held is None or own[0] != held[0]:
                    if held is not None:
                        yield from sent(held[0], lane)
                    lane = _Lane(begun, steps, blank, rate)
                elif own != held:
                    lane.move()
                held = own
                lane.add(x[i:j])
        if held is not None:
            yield from sent(held[0], lane)

    def mean(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("lane").to_numpy())
        rows = table.column("rows").to_numpy()[order]
        total = rows @ to_matrix(table.column("total"))[order] / rows.sum()
        return pa.table({
            "piece": table.column("piece")[:1], "total": to_lists(total[None, :], pa.float64()),
            "rows": pa.array([rows.sum()], pa.int64()),
            "steps": pa.array([table.column("steps").to_numpy().max()], pa.int64()),
            "loss": pa.array([table.column("loss").to_numpy()[order].sum()], pa.float64())})

    made = dealt.mapInArrow(run, "lane int, " + _EPOCH)
    return made.groupBy("piece").applyInArrow(mean, _EPOCH)


def _read_epoch(spark: SparkSession, folder: str, epoch: int) -> tuple[np.ndarray, int, float]:
    """Weights and moments, the steps so far, and the mean loss of an epoch's rows."""
    rows = spark.read.schema(_EPOCH).parquet(f"{folder}/weights/epoch={epoch}").orderBy("piece").collect()
    return np.concatenate([r["total"] for r in rows]), rows[0]["steps"], rows[0]["loss"] / rows[0]["rows"]


def _history(spark: SparkSession, folder: str, widths: list[int]) -> list[tuple[float, int]]:
    """Error and steps of each epoch that a folder holds whole."""
    if not exists(spark, f"{folder}/errors"):
        return []
    rows = spark.read.schema(_ERRORS + ", epoch int").parquet(f"{folder}/errors").orderBy("epoch").collect()
    if any(r["widths"] != widths for r in rows):
        raise ValueError(f"{folder} holds a model of widths {rows[0]['widths']}, not {widths}")
    return [(r["error"], r["steps"]) for r in rows]


def fit_mlp(
    train: DataFrame,
    validation: DataFrame,
    input_dim: int,
    output_dim: int,
    key: str,
    vector: str = "embedding",
    hidden: Sequence[int] = HIDDEN,
    batch_size: int = 256,
    learning_rate: float = 1e-3,
    epochs: int = 100,
    epoch_length: int = 100,
    patience: int = 10,
    final_relu: bool = False,
    seed: int = 0,
    start: Autoencoder | None = None,
    lanes: int = LANES,
    folder: str | None = None,
    keep_epochs: int = 5,
) -> Autoencoder:
    """Train an autoencoder by epochs; the weights with the best validation error win.

    An epoch reads the training rows once and the validation rows once. It draws rows by
    hash and deals them to ``lanes`` copies of the weights; each takes ``epoch_length`` steps of Adam,
    on about ``batch_size`` rows each, and the epoch ends with the mean of the copies, so only one
    set of weights a lane crosses the network. ``lanes`` is part of the result, the cluster isn't:
    the same call gives the same weights on any number of executors.

    Weights and moments are written to ``folder/weights/epoch=N`` by the tasks, then the error to
    ``folder/errors``. A call with a folder that holds epochs goes on after the last whole one
    (``epochs`` counts these too). The last epoch and the ``keep_epochs`` latest that improved stay.
    Training stops after ``patience`` epochs without a better error. ``start`` gives the first weights.

    Vectors must have ``input_dim`` numbers (see ``split_by_width``), others are an error. Without training rows
    the first weights come back; without validation rows the training error of an epoch decides.
    """
    spark = train.sparkSession
    rng = np.random.default_rng(seed)
    if start is None:
        enc = _start([input_dim, *hidden, output_dim], rng, True)
        dec = _start([output_dim, *reversed(hidden), input_dim], rng, final_relu)
    else:
        enc, dec = list(start.encoder), list(start.decoder)
    layers = [*enc, *dec]
    widths = [layers[0].weight.shape[1], *[len(la.bias) for la in layers]]

    def model(state: np.ndarray) -> Autoencoder:
        made = _filled(state[:len(state) // 3], layers)
        return Autoencoder(tuple(made[:len(enc)]), tuple(made[len(enc):]))

    state = np.concatenate([_flat(layers), np.zeros(2 * len(_flat(layers)))])
    if 8 * len(state) > BROADCAST_BYTES:
        raise ValueError(f"{8 * len(state)} bytes of weights are over the bound of {BROADCAST_BYTES}")
    folder = folder.rstrip("/") if folder else new_path(spark)
    history, steps = _history(spark, folder, widths), 0
    if history:
        state, steps, _ = _read_epoch(spark, folder, len(history) - 1)
    n_train = train.count()
    if n_train == 0:
        return model(state)
    while len(history) < epochs:
        errors = [e for e, _ in history]
        if errors and len(errors) - 1 - int(np.argmin(errors)) >= patience:
            break
        epoch = len(history)
        dealt = _dealt(train, n_train, key, vector, lanes, epoch_length, batch_size, seed + epoch + 1)
        _trained(dealt, state, steps, layers, learning_rate, vector).write.mode(
            "overwrite").parquet(f"{folder}/weights/epoch={epoch}")
        state, steps, loss = _read_epoch(spark, folder, epoch)
        error = reconstruction_mse(validation, model(state), [], vector).first()[0]
        error = loss if error is None else error
        spark.createDataFrame([(error, loss, steps, widths)], _ERRORS).coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/errors/epoch={epoch}")
        history.append((error, steps))
        _forget(spark, folder, [e for e, _ in history], keep_epochs)
    if not history:
        return model(state)
    best = int(np.argmin([e for e, _ in history]))
    return model(_read_epoch(spark, folder, best)[0])


def _improved(errors: Sequence[float]) -> list[int]:
    return [i for i, e in enumerate(errors) if e < min(errors[:i], default=np.inf)]


def _forget(spark: SparkSession, folder: str, errors: Sequence[float], keep_epochs: int) -> None:
    """Delete the weights that the newest epoch has made superfluous."""
    def kept(upto: int) -> set[int]:
        return {upto - 1, *_improved(errors[:upto])[-max(1, keep_epochs):]}

    for epoch in kept(len(errors) - 1) - kept(len(errors)) if len(errors) > 1 else ():
        remove(spark, f"{folder}/weights/epoch={epoch}")


def fit_reducer(train: DataFrame, validation: DataFrame, input_dim: int, output_dim: int, key: str,
                method: str = "pca", vector: str = "embedding", **options) -> Autoencoder:
    """``'pca'`` fits in one pass; ``'mlp'`` trains an autoencoder by epochs."""
    if method == "pca":
        return fit_pca(train, output_dim, vector)
    if method == "mlp":
        return fit_mlp(train, validation, input_dim, output_dim, key, vector, **options)
    raise ValueError("method is 'pca' or 'mlp'")


def weights_table(spark: SparkSession, model: Autoencoder) -> DataFrame:
    """The model as a table, one row per output of a layer; decoder layers follow."""
    layers = (*model.encoder, *model.decoder)
    rows = [(i, r, [float(x) for x in w], float(b), la.relu, i < len(model.encoder))
            for i, la in enumerate(layers) for r, (w, b) in enumerate(zip(la.weight, la.bias))]
    return spark.createDataFrame(rows, LAYER_SCHEMA + ", relu boolean, is_encoder boolean")


def read_weights(table: DataFrame) -> Autoencoder:
    """The model of a weights table."""
    size = table.agg(F.sum(F.size("weights") + 1)).first()[0] * 8
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of weights are over the bound of {BROADCAST_BYTES}")
    layers: dict[int, list] = {}
    for r in table.orderBy("layer", "row").collect():
        layers.setdefault(r["layer"], []).append(r)
    parts = {True: [], False: []}
    for _, rows in sorted(layers.items()):
        parts[rows[0]["is_encoder"]].append(Layer(
            np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows]),
            rows[0]["relu"]))
    return Autoencoder(tuple(parts[True]), tuple(parts[False]))
