"""Pure NumPy kernels on 2-D arrays (rows are series); no Spark here."""
