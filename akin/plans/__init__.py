"""The experiments: search quality, keyword search, estimate accuracy and their sweeps."""
