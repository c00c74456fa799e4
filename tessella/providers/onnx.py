"""Optional provider that runs ONNX graphs on the CPU, if onnxruntime can be imported."""

from __future__ import annotations

import numpy as np

from ..operators.catalog import select_artifact
from .base import Provider, register

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

#: Tensor types that raw runs take and give.
TYPES = {"tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int32)": np.int32, "tensor(int64)": np.int64, "tensor(bool)": np.bool_}


class RawModel:
    def __init__(self, path: str, options: dict):
        so = onnxruntime.SessionOptions()
        so.intra_op_num_threads = int(options.get("intra_op_num_threads", 1))  # one task slot, one thread
        so.inter_op_num_threads = int(options.get("inter_op_num_threads", 1))
        self.session = onnxruntime.InferenceSession(path, so, providers=["CPUExecutionProvider"])
        self.most = int(options.get("max_batch_size", 64))

    def signature(self) -> dict:
        io = lambda xs: {x.name: (x.type, x.shape) for x in xs}
        return {"inputs": io(self.session.get_inputs()), "outputs": io(self.session.get_outputs())}

    def run(self, batch: list[dict]) -> list[dict]:
        """Named tensors in and out, stacked up to max_batch_size rows at once where the first axis is free."""
        inputs, out = self.session.get_inputs(), []
        fixed = inputs[0].shape and isinstance(inputs[0].shape[0], int)
        step = 1 if fixed else self.most
        for a in range(0, len(batch), step):
            rows = batch[a:a + step]
            feed = {i.name: np.asarray([r[i.name] for r in rows] if not fixed else rows[0][i.name], TYPES[i.type]) for i in inputs}
            made = dict(zip([o.name for o in self.session.get_outputs()], self.session.run(None, feed)))
            out += [{k: (v[j] if not fixed else v).tolist() for k, v in made.items()} for j in range(len(rows))]
        return out


class Onnx(Provider):
    provider_id = "local/onnx"
    tasks = ("raw",)

    def load(self, task: str, model_id: str, options: dict):
        if onnxruntime is None:
            raise RuntimeError("onnxruntime is not installed")
        import os

        files = [model_id] if model_id.endswith(".onnx") else [os.path.join(model_id, select_artifact(os.listdir(model_id), options.get("artifact")))]
        return RawModel(files[0], options)


register(Onnx())
