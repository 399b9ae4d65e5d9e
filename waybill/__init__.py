"""waybill: Spark jobs for moving, comparing, checking and watching warehouse tables."""
