"""An embedder over two ONNX files of one space, for images and for texts."""

from __future__ import annotations

import numpy as np

from ..functions.pixels import model_input

TEXT_TOKENS = 77


class OnnxEmbedder:
    """Sessions are opened where they are first used, so the object travels as three paths that executors see."""

    def __init__(self, vision: str, text: str, tokenizer: str):
        self.paths = (vision, text, tokenizer)
        self._open: dict = {}

    def __getstate__(self):
        return {"paths": self.paths, "_open": {}}

    def _session(self, which: int):
        if which not in self._open:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._open[which] = onnxruntime.InferenceSession(self.paths[which], options, providers=["CPUExecutionProvider"])
        return self._open[which]

    def _run(self, which: int, values: np.ndarray) -> list[float]:
        session = self._session(which)
        names = [i.name for i in session.get_inputs()]
        feed = {names[0]: values} | {n: np.ones_like(values) for n in names[1:] if "mask" in n}
        out = np.asarray(session.run(None, feed)[0], float).ravel()
        n = float(np.sqrt((out * out).sum()))
        return (out / n if n > 0 else out).tolist()

    def image(self, rgb: np.ndarray) -> list[float]:
        return self._run(0, model_input(rgb)[None])

    def text(self, text: str) -> list[float]:
        return self._run(1, np.array([truncated(self._tokenizer().encode(text).ids)], np.int64))

    def _tokenizer(self):
        if "tokenizer" not in self._open:
            from tokenizers import Tokenizer

            self._open["tokenizer"] = Tokenizer.from_file(self.paths[2])
        return self._open["tokenizer"]


def truncated(ids: list[int], most: int = TEXT_TOKENS) -> list[int]:
    """At most so many ids, the last of which stays the last."""
    return ids if len(ids) <= most else [*ids[: most - 1], ids[-1]]
