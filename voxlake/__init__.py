"""voxlake: customer-feedback analytics as plain Spark DataFrame transformations."""
