"""workloads"""
