"""Named queries over the supplied tables; importing this package registers them all."""

from hornfels.plans import derivations, forms, graphs, interprocedural, measures, programs, relations, streams, traces, weighted
from hornfels.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "derivations", "forms", "graphs", "interprocedural", "measures", "programs", "relations", "streams", "traces", "weighted"]
