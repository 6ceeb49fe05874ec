"""Corvane: a Spark analytics library for structural-contact data.

``sources`` reads and writes structures, ligands and contact libraries; ``functions`` are column
expressions and the numeric kernels behind Arrow UDFs; ``operators`` are DataFrame to DataFrame;
``plans`` binds them to the benchmark tables; ``streaming`` holds the incremental forms.
"""
