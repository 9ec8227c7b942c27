"""The engine's analytics are batch jobs over whole networks: rankings and evaluations need
all edges, so there is no streaming surface."""
